"""Paired generation plans, their validation, and blinded scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import padded, seeded_key
from ..plans.working import settle
from .ordering import numbered
from .streams import two_way_shuffles

# The evaluation's controlled settings.
SEEDS = (1001, 1002)
CONDITIONS = ("base", "lora")
GUIDANCE, STEPS, WIDTH, HEIGHT = 3.5, 20, 1024, 1024
REQUIRED_TAGS = ("[FOUR-VIEWS]", "[TOP-LEFT]", "[TOP-RIGHT]", "[BOTTOM-LEFT]", "[BOTTOM-RIGHT]")
SCORE_FIELDS = ("identity_consistency_1_5", "distinct_views_1_4", "duplicate_pairs_0_6", "prompt_fidelity_1_5", "valid_grid")
CONTROLLED = ("prompt", "guidance_scale", "num_inference_steps", "width", "height")


def missing_tags(prompt) -> F.Column:
    return F.filter(F.array(*map(F.lit, REQUIRED_TAGS)), lambda t: ~F.contains(prompt, t))


def tagged(prompt) -> F.Column:
    """The prompt with the leading tag, put before it where it is not there."""
    return F.when(F.startswith(prompt, F.lit(REQUIRED_TAGS[0])), prompt).otherwise(F.concat(F.lit(REQUIRED_TAGS[0] + " "), prompt))


def prompt_errors(prompts: DataFrame) -> DataFrame:
    """(id, error) of prompts with a null field, a missing tag or a repeated id."""
    null = F.col("id").isNull() | F.col("prompt").isNull()
    gone = missing_tags(F.col("prompt"))
    own = prompts.select("id", F.when(null, "id and prompt must be strings").when(F.size(gone) > 0, F.concat(F.lit("missing tags "), F.array_join(gone, ", "))).alias("error")).where("error is not null")
    repeated = prompts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id is repeated").alias("error"))
    return own.unionByName(repeated)


def generation_plan(prompts: DataFrame) -> DataFrame:
    """Each prompt with every seed and condition: an explode of two constants, no join."""
    combos = F.array(*(F.struct(F.lit(s).alias("seed"), F.lit(c).alias("condition")) for s in SEEDS for c in CONDITIONS))
    each = prompts.select(F.col("id").cast("string").alias("prompt_id"), "prompt", F.explode(combos).alias("c"))
    return each.select(
        "prompt_id", "prompt", "c.seed", "c.condition", F.lit(GUIDANCE).alias("guidance_scale"), F.lit(STEPS).alias("num_inference_steps"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")
    )


def generation_records(plan: DataFrame, run_config: dict[str, str], *, device: str = "cpu") -> DataFrame:
    """The plan merged with a run's settings (the run's win) and the seed-reset facts."""
    facts = {"generator_device": F.lit(device), "generator_reset_per_condition": F.lit(True), "lora_fused": F.lit(False)}
    return plan.withColumns({k: F.lit(v) for k, v in run_config.items()} | facts)


def pair_errors(records: DataFrame) -> DataFrame:
    """(prompt_id, seed, error) of pairs without exactly one record per condition, or whose
    controlled fields differ. A field that the records do not have at all raises."""
    if gone := [f for f in CONTROLLED if f not in records.columns]:
        raise ValueError(f"records lack the controlled fields {', '.join(gone)}")
    fields = list(CONTROLLED)
    differ = [(f, ~F.min(f).eqNullSafe(F.max(f)) | ((F.count(f) > 0) & (F.count(f) < F.count("*")))) for f in fields]
    grouped = records.groupBy(F.col("prompt_id").cast("string").alias("prompt_id"), F.col("seed").cast("int").alias("seed")).agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("condition") == c).alias(f"n_{c}") for c in CONDITIONS),
        F.array_compact(F.array(*(F.when(d, F.lit(f)) for f, d in differ))).alias("fields") if differ else F.array().cast("array<string>").alias("fields"),
    )
    whole = (F.col("n") == len(CONDITIONS)) & F.lit(True)
    for c in CONDITIONS:
        whole = whole & (F.col(f"n_{c}") == 1)
    error = F.when(~whole, "expected exactly one record for each condition").when(F.size("fields") > 0, F.concat(F.lit("controlled fields differ: "), F.array_join("fields", ", ")))
    return grouped.select("prompt_id", "seed", error.alias("error")).where("error is not null")


def by_condition(records: DataFrame) -> DataFrame:
    """A row per (prompt_id, seed) with each condition's record as a struct; null where it lacks."""
    own = F.struct(*(c for c in records.columns if c not in ("prompt_id", "seed", "condition")))
    each = (F.max_by(F.when(F.col("condition") == c, own), F.when(F.col("condition") == c, F.lit(1))).alias(c) for c in CONDITIONS)
    return records.groupBy(F.col("prompt_id").cast("string").alias("prompt_id"), F.col("seed").cast("int").alias("seed")).agg(*each)


def blinded(records: DataFrame, *, seed: int | str = 17) -> DataFrame:
    """Adds pair_number (from 1, by prompt and seed) and blind_label (A or B by seeded hash within
    the pair). Pairs are numbered over their distinct keys only."""
    keys = numbered(records.select("prompt_id", "seed").distinct(), ["prompt_id", "seed"], "__k")
    keys = keys.select(F.col("prompt_id").alias("__p"), F.col("seed").alias("__s"), (F.col("__k") + 1).cast("int").alias("pair_number"))
    joined = records.join(keys, F.col("prompt_id").eqNullSafe(F.col("__p")) & F.col("seed").eqNullSafe(F.col("__s"))).drop("__p", "__s")
    ident = F.concat_ws("\n", "prompt_id", F.col("seed").cast("string"), "condition")
    order = Window.partitionBy("prompt_id", "seed").orderBy(seeded_key(seed, ident), "condition")
    return joined.withColumn("blind_label", F.element_at(F.array(F.lit("A"), F.lit("B")), F.row_number().over(order)))


def blinded_by_stream(records: DataFrame, *, seed: int = 17) -> DataFrame:
    """As `blinded`, with the labels that one random stream gives, pair after pair: those of shuffling
    each pair's conditions by `random.Random(seed)`."""
    keys = settle(numbered(records.select("prompt_id", "seed").distinct(), ["prompt_id", "seed"], "__k"))
    drawn = two_way_shuffles(records.sparkSession, seed, keys.count())
    keys = keys.join(drawn, F.col("__k") == F.col("ordinal")).select(F.col("prompt_id").alias("__p"), F.col("seed").alias("__s"), (F.col("__k") + 1).cast("int").alias("pair_number"), "swapped")
    joined = records.join(keys, F.col("prompt_id").eqNullSafe(F.col("__p")) & F.col("seed").eqNullSafe(F.col("__s"))).drop("__p", "__s")
    first = (F.col("condition") == CONDITIONS[0]) != F.col("swapped")
    return joined.withColumn("blind_label", F.when(first, "A").otherwise("B")).drop("swapped")


def pair_id(number) -> F.Column:
    return F.concat(F.lit("pair-"), padded(number, 3))


def scorecard(blind: DataFrame) -> DataFrame:
    """Rows to score: no condition, blank score fields."""
    ident = pair_id(F.col("pair_number"))
    image = F.concat(F.lit("images/"), ident, F.lit("_"), F.col("blind_label"), F.lit(".png"))
    return blind.select(ident.alias("pair_id"), "prompt_id", "seed", "blind_label", image.alias("image_path"), "prompt", *(F.lit("").alias(f) for f in SCORE_FIELDS))


def blind_copies(blind: DataFrame, folder: str) -> DataFrame:
    """(source, target): where each output goes under its blind name. For `placing.copy_files`."""
    image = F.concat(F.lit(folder.rstrip("/") + "/images/"), pair_id(F.col("pair_number")), F.lit("_"), F.col("blind_label"), F.lit(".png"))
    return blind.select(F.col("output_path").alias("source"), image.alias("target"))


def blind_key(blind: DataFrame) -> DataFrame:
    path = F.col("output_path") if "output_path" in blind.columns else F.lit(None).cast("string")
    return blind.select("blind_label", "condition", path.alias("original_output_path"), pair_id(F.col("pair_number")).alias("pair_id"), "prompt_id", "seed")
