"""Readers. Each gives a DataFrame, with an error table beside it where the input is strict; nothing
is opened outside Spark's own sources, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import stem, strip, suffix
from ..functions.typed_json import type_errors
from ..operators.identity import path_keys

# The fields of a cache entry.
ENVELOPE_KEYS = (
    "cache_schema_version", "model_id", "prompt_version", "latency_ms", "input_image_sha256", "source_image_sha256",
    "category", "raw_response_text", "parsed_annotation", "validation_outcome", "validation_errors",
)


def image_files(spark: SparkSession, root: str, glob: str = "*.jpg") -> DataFrame:
    """Images that lie directly in a directory named `images`, with the keys of their path. Content
    is not selected, so it is not read. Files whose names begin with . or _ and empty directories are
    not seen by Spark's file sources."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
    keyed = files.select("path", *(c.alias(k) for k, c in path_keys(F.col("path"), root).items()))
    return keyed.where(F.element_at(F.split("image_dir", "/"), -1) == "images")


def with_content(picks: DataFrame, root: str, glob: str = "*.jpg") -> DataFrame:
    """Adds content and sha256 to picked paths: only their bytes leave the scan."""
    spark = picks.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return picks.join(files.select("path", "content"), "path").withColumn("sha256", F.sha2("content", 256))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value): a file's lines are in order of block and row."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): numbered lines of text files. Lines are numbered within the blocks in
    which Spark reads a file, and moved on by the counts of the blocks before."""
    raw = _placed(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    base = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("row"))
    return raw.withColumn("nth", nth).join(base, ["file", "block"]).select("file", (F.col("base") + F.col("nth")).cast("int").alias("line_no"), "value")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(obj_id, category) of `id,name` lines; lines without a comma are skipped, the last of equal
    ids wins."""
    parts = F.split(strip(F.col("value")), ",", 2)
    rows = lines_of(spark, path).where(F.contains("value", F.lit(","))).select(parts[0].alias("obj_id"), parts[1].alias("category"), "line_no")
    return rows.groupBy("obj_id").agg(F.max_by("category", "line_no").alias("category"))


def _object_errors(text: Column, schema: StructType | str, optional: Collection[str], closed: bool) -> Column:
    """An array with what is wrong with a line: one thing if it is no object, else its type errors."""
    parsed = F.try_parse_json(text)
    whole = F.when(parsed.isNull(), "invalid JSON").when(F.json_object_keys(text).isNull(), "not an object")
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(type_errors(parsed, schema, optional=optional, closed=closed))


def strict_jsonl(spark: SparkSession, path: str, schema: StructType | str, *, optional: Collection[str] = (), closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): objects by line, and (file, line_no, error) for every blank or broken line and
    every place where a value is not of the schema's type, out of its range, null where that may not
    be, or missing (see `type_errors`). Nothing is coerced, and a line with an error gives no row."""
    blank = strip(F.col("value")) == ""
    told = F.when(blank, F.array(F.lit("blank line"))).otherwise(_object_errors(F.col("value"), schema, optional, closed))
    checked = lines_of(spark, path).withColumn("errors", told)
    rows = checked.where(F.size("errors") == 0).select("line_no", F.from_json("value", schema).alias("r")).select("line_no", "r.*")
    return rows, checked.select("file", "line_no", F.explode("errors").alias("error"))


def keyed_jsonl(spark: SparkSession, path: str, schema: StructType | str, key: str = "key", *, optional: Collection[str] = (), closed: bool = False) -> DataFrame:
    """Objects by key: blank lines are skipped, the last of equal keys wins. Lines that are no JSON
    object, have no key or are not of the schema's types are for `keyed_errors` to tell."""
    rows = _placed(spark, path).where(F.size(_object_errors(F.col("value"), schema, optional, closed)) == 0)
    rows = rows.select(F.struct("file", "block", "row").alias("place"), F.from_json("value", schema).alias("r"))
    last = rows.where(F.col(f"r.{key}").isNotNull()).groupBy(F.col(f"r.{key}").alias("__k")).agg(F.max_by("r", "place").alias("r"))
    return last.select("r.*")


def keyed_errors(
    spark: SparkSession, path: str, key: str = "key", schema: StructType | str | None = None, *, optional: Collection[str] = (), closed: bool = False
) -> DataFrame:
    """(file, line_no, error) of the lines that `keyed_jsonl` passes over, but for blank ones; type
    errors are told if the schema is given."""
    lines = lines_of(spark, path).where(strip(F.col("value")) != "")
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
    error = (
        F.when(parsed.isNull(), "invalid JSON").when(F.json_object_keys("value").isNull(), "not an object").when(F.coalesce(kind, F.lit("VOID")) == "VOID", f"no {key}")
    )
    typed = type_errors(parsed, schema, optional=optional, closed=closed) if schema is not None else F.array().cast("array<string>")
    every = F.when(error.isNotNull(), F.array(error)).otherwise(typed)
    return lines.select("file", "line_no", F.explode(every).alias("error"))


def json_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The object of a whole JSON file in one row; raises when it is read if it is none."""
    text = spark.read.text(path, wholetext=True)
    fine = F.json_object_keys("value").isNotNull() & F.try_parse_json("value").isNotNull()
    message = F.concat(F.lit("Expected a JSON object in "), F.col("_metadata.file_path"))
    return text.select(F.from_json(F.when(fine, F.col("value")).otherwise(F.raise_error(message)), schema).alias("r")).select("r.*")


GENERATION = "prompt_id string, prompt string, seed int, condition string, guidance_scale double, num_inference_steps int, width int, height int, output_path string"


def generation_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a generation manifest: broken lines, fields that are missing or of another
    type, and pairs that are not whole or whose controlled fields differ. Relative output paths are
    taken from the manifest's folder."""
    from ..operators.evaluation import pair_errors

    rows, bad = strict_jsonl(spark, path, GENERATION)
    folder = path.rstrip("/").rpartition("/")[0]
    given = F.col("output_path")
    rows = rows.withColumn("output_path", F.when(given.startswith("/") | given.rlike(r"^[a-z0-9]+:"), given).otherwise(F.concat(F.lit(folder + "/"), given)))
    told = pair_errors(rows).select(F.concat_ws("/", "prompt_id", "seed").alias("place"), "error")
    return rows, bad.select(F.concat_ws(":", "file", "line_no").alias("place"), "error").unionByName(told)


def prompts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, prompt) rows and the errors of lines, fields, tags and ids."""
    from ..operators.evaluation import prompt_errors

    # read as variants, for a number would pass as a string otherwise
    rows, bad = strict_jsonl(spark, path, "id variant, prompt variant")
    text = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
    found = rows.select(text("id").alias("id"), text("prompt").alias("prompt"))
    none = rows.limit(1).count() == 0 and bad.limit(1).count() == 0
    if none:
        raise ValueError(f"no prompts in {path}")
    told = bad.select(F.concat_ws(":", "file", "line_no").alias("id"), "error").unionByName(prompt_errors(found))
    return found, told


#: The types of a cache entry's fields, for readers that are to check them.
ENVELOPE = """cache_schema_version string not null, model_id string not null, prompt_version string not null, latency_ms double not null,
input_image_sha256 string not null, source_image_sha256 array<string> not null, category string not null, raw_response_text string not null,
parsed_annotation variant, validation_outcome string not null, validation_errors array<string> not null"""


def cache_envelopes(spark: SparkSession, path: str, schema: StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, envelope text as `value`) of whole, complete cache files, and (file, error) of others.
    With a schema (ENVELOPE) the fields' types are checked as well."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    gone = F.array_sort(F.array_except(F.array(*map(F.lit, ENVELOPE_KEYS)), F.json_object_keys("value")))
    typed = type_errors(F.try_parse_json("value"), schema) if schema is not None else F.array().cast("array<string>")
    error = (
        F.when(F.try_parse_json("value").isNull(), "invalid JSON")
        .when(F.json_object_keys("value").isNull(), "not an object")
        .when(F.size(gone) > 0, F.concat(F.lit("missing keys: "), F.array_join(gone, ", ")))
        .when(F.size(typed) > 0, F.array_join(typed, "; "))
    )
    checked = files.withColumn("error", error)
    return checked.where("error is null").drop("error"), checked.where("error is not null").select("file", "error")


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(stem, caption) of whole text files, stripped."""
    files = spark.read.text(path, wholetext=True)
    return files.select(stem(F.input_file_name()).alias("stem"), strip(F.col("value")).alias("caption"))


def stems(spark: SparkSession, root: str) -> DataFrame:
    """(name, stem, suffix) of a directory's files; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), stem(name).alias("stem"), suffix(name).alias("suffix"))


def captioned(files: DataFrame) -> DataFrame:
    """Images that have a caption of the same stem."""
    texts = files.where("suffix = '.txt'").select("stem")
    return files.where("suffix = '.png'").join(texts, "stem", "left_semi")
