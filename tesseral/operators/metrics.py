"""Quality figures of annotations and of paired evaluations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio, seeded_key
from ..plans.working import settle
from .filters import any_might, bits_for
from .ordering import numbered, running, running_max


def valid_rate(rows: DataFrame, valid: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), ratio(F.count_if(valid), F.count("*")).alias("valid_rate"))


def per_class(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts, precision, recall and F1 of each class that occurs as gold or prediction."""
    pairs = rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col(gold).alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("t")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"), F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0).alias("t")),
    )
    sums = pairs.select(F.explode(sides).alias("s")).groupBy("s.label").agg(F.sum("s.g").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.t").alias("hits"))
    f1 = F.coalesce(ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return sums.select("label", "support", "predicted", "hits", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), f1.alias("f1"))


def macro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return per_class(rows, gold, predicted).agg(F.count("*").alias("n_classes"), F.avg("f1").alias("macro_f1"))


def tuple_accuracy(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    equal = F.lit(True)
    for gold, predicted in pairs:
        equal = equal & F.col(gold).eqNullSafe(F.col(predicted))
    return rows.agg(F.count("*").alias("n"), ratio(F.count_if(equal), F.count("*")).alias("exact_accuracy"))


def abstention(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Precision, recall and F1 of abstaining, over-abstention and false determination."""
    both, g, p, n = F.count_if(gold & predicted), F.count_if(gold), F.count_if(predicted), F.count("*")
    return rows.agg(
        ratio(both, p).alias("precision"),
        ratio(both, g).alias("recall"),
        ratio(2 * both, g + p).alias("f1"),
        ratio(F.count_if(~gold & predicted), n - g).alias("over_abstention"),
        ratio(F.count_if(gold & ~predicted), n - p).alias("false_determination"),
    )


def claims(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro precision and recall of claims, mean claims per row, and the part of claims not in gold."""
    hits = F.size(F.array_intersect(gold, predicted))
    h, g, p = F.sum(hits), F.sum(F.size(F.array_distinct(gold))), F.sum(F.size(F.array_distinct(predicted)))
    return rows.agg(ratio(h, p).alias("precision"), ratio(h, g).alias("recall"), F.avg(F.size(F.array_distinct(predicted))).alias("specificity"), ratio(p - h, p).alias("hallucination_rate"))


def brier(rows: DataFrame, probability: str, outcome: str) -> DataFrame:
    d = F.col(probability) - F.col(outcome)
    return rows.agg(F.count("*").alias("n"), F.avg(d * d).alias("brier"))


def calibration_bins(rows: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(F.col(outcome).cast("double")).alias("accuracy"))


def ece(rows: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: gaps of equal-width bins, weighed by their size."""
    return calibration_bins(rows, probability, outcome, bins).agg(ratio(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")).alias("ece"))


def risk_coverage(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """For each confidence from which one would answer: rows answered, coverage and risk. Summed by
    distinct confidence first; the running sums then run over those, range by range."""
    c = rows.groupBy(confidence).agg(F.count("*").alias("n"), F.count_if(F.col(correct) == 0).alias("wrong"))
    c = c.withColumn("__neg", -F.col(confidence))
    seen = running(running(c, ["__neg"], "n", "__n"), ["__neg"], "wrong", "__w")
    total = rows.count()
    answered, wrong = F.col("__n") + F.col("n"), F.col("__w") + F.col("wrong")
    return seen.select(confidence, answered.alias("answered"), ratio(answered, F.lit(total)).alias("coverage"), ratio(wrong, answered).alias("risk"))


def latency_report(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max"))


#: Size of a quantile sketch: rank errors stay within `rank_error(SKETCH)` with 99 % probability.
SKETCH = 400


def rank_error(k: int = SKETCH) -> float:
    """The normalised rank error of one quantile from a sketch of size k (fixed values of the
    published error curve)."""
    return 2.296 / k**0.9723


def latency_sketches(rows: DataFrame, group: list[str], value: str, *, k: int = SKETCH) -> DataFrame:
    """(group, n, sketch): a mergeable quantile sketch of each group's values, a few kB however many
    there are. To be stored by day and merged later."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of larger groups from those of their parts."""
    return sketches.groupBy(*group).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """Quantiles of sketches, by name."""
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(c) for c, q in ranks.items()))


def usage_report(rows: DataFrame, group: list[str], prices: dict[str, float]) -> DataFrame:
    """Calls, tokens and estimated cost of each group; `prices` has the price of a million tokens of
    each token column. Missing counts are no tokens."""
    n = {c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long") for c in prices}
    cost = sum((n[c] * F.lit(p) / F.lit(1e6) for c, p in prices.items()), F.lit(0.0))
    return rows.groupBy(*group).agg(F.count("*").alias("calls"), *(v.alias(c) for c, v in n.items()), cost.alias("cost"), ratio(cost, F.count("*")).alias("cost_per_call"))


def select_model(models: DataFrame, gates: list[Column], order: list[Column]) -> DataFrame:
    """The first model that passes all gates, in order of the tie-breaks."""
    for gate in gates:
        models = models.where(gate)
    return models.orderBy(*order).limit(1)


def wilson_lower(hits: Column, n: Column, z: float = 1.6448536269514722) -> Column:
    """One-sided lower bound of a proportion, 95 % by default."""
    p, n = hits / n, n.cast("double")
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


# The coefficients of the Lanczos approximation of the gamma function (g = 7).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function from 1 on."""
    x = x.cast("double") - 1
    series = reduce(lambda s, ic: s + F.lit(ic[1]) / (x + ic[0]), enumerate(LANCZOS[1:], 1), F.lit(LANCZOS[0]))
    t = x + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.ln(t) - t + F.ln(series)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forwards. It needs about as
    many terms as the root of the larger parameter."""
    tiny, one = F.lit(1e-300), F.lit(1.0)
    whole = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def term(acc: Column, factor: Column) -> Column:
        d, c = one / whole(one + factor * acc["d"]), whole(one + factor / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def step(acc: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.get(F.transform(F.array(term(acc, even)), lambda half: term(half, odd)), 0)

    first = one / whole(one - (a + b) * x / (a + 1))
    terms = F.sequence(F.lit(1), F.ceil(F.lit(60) + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(terms, F.struct(one.alias("c"), first.alias("d"), first.alias("h")), step, lambda acc: acc["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), a and b from 1 on."""
    x, a, b = (c.cast("double") for c in (x, a, b))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    direct = x < (a + 1) / (a + b + 2)
    inside = F.when(direct, front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(1 - x, b, a) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def exact_lower(hits: Column, n: Column, alpha: float = 0.05) -> Column:
    """One-sided lower bound of a proportion after Clopper and Pearson: the proportion with which `hits`
    or more of n come with probability alpha. Found by halving, to the last digits of a double."""

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        return F.get(F.transform(F.array(incomplete_beta(middle, hits, n - hits + 1) < alpha), lambda low: F.struct(F.when(low, middle).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(middle).alias("hi"))), 0)

    ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(52)), ends, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when(hits <= 0, 0.0).otherwise(found)


def calibrated_threshold(rows: DataFrame, confidence: str, correct: str, *, precision: float = 0.9, coverage: float = 0.5, bound: str = "wilson") -> DataFrame:
    """The lowest confidence from which the precision's one-sided 95 % lower bound and the coverage
    suffice. The bound is Wilson's or, with `exact`, that of Clopper and Pearson; whether the exact one
    suffices takes one tail probability at the wanted precision, so only the result's is searched for."""
    if bound not in ("wilson", "exact"):
        raise ValueError("the bound is wilson or exact")
    curve = risk_coverage(rows, confidence, correct).where(F.col("coverage") >= coverage)
    hits, n = F.rint(F.col("answered") * (1 - F.col("risk"))), F.col("answered")
    if bound == "wilson":
        return curve.withColumn("lower", wilson_lower(hits, n)).where(F.col("lower") >= precision).orderBy(confidence).limit(1)
    near = curve.where(hits >= precision * n)
    enough = near.where(incomplete_beta(F.lit(float(precision)), hits, n - hits + 1) <= 0.05)
    return enough.orderBy(confidence).limit(1).withColumn("lower", exact_lower(hits, n))


def stratified(rows: DataFrame, stratum: str, ident: str, fraction: float, *, seed: str | int = 17) -> DataFrame:
    """Rows whose rank by seeded hash lies within `fraction` of their stratum. Rows are numbered over
    all tasks, strata one after another, so a large stratum is not ranked by one of them."""
    ranked = numbered(rows.withColumn("__key", seeded_key(seed, F.col(ident))), [stratum, "__key", ident], "__r")
    parts = ranked.groupBy(F.col(stratum).alias("__s")).agg(F.min("__r").alias("__first"), F.count("*").alias("__n"))
    own = ranked.join(parts, F.col(stratum).eqNullSafe(F.col("__s")))
    return own.where(F.col("__r") - F.col("__first") + 1 <= F.rint(F.col("__n") * fraction)).drop("__key", "__r", "__s", "__first", "__n")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tile_pairs(rows: DataFrame, group: str, position: str, vector: str, *, duplicate_from: float = 0.95) -> DataFrame:
    """Similarity of each two members of a group (six pairs of a group of four), and whether they
    are near copies. Groups must be small: pairs are made within a row of one group."""
    members = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(vector).alias("v")))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["p"] > a["p"]), lambda b: F.struct(a["p"].alias("a"), b["p"].alias("b"), cosine(a["v"], b["v"]).alias("similarity")))))
    each = members.select(group, F.explode(pairs).alias("x")).select(group, "x.*")
    return each.withColumn("duplicate", F.col("similarity") >= duplicate_from)


def holm(tests: DataFrame, ident: str, p_value: str) -> DataFrame:
    """Holm's step-down adjustment over a family of tests of any size: ranks and running maxima are
    found range by range."""
    m = tests.count()
    scaled = numbered(tests, [p_value, ident], "__r").withColumn("__s", F.col(p_value) * (F.lit(m) - F.col("__r")))
    return running_max(scaled, [p_value, ident], "__s", "adjusted").withColumn("adjusted", F.least(F.lit(1.0), "adjusted")).drop("__r", "__s")


def bootstrap(rows: DataFrame, group: str | list[str], value: str, *, resamples: int = 200, seed: str | int = 17) -> DataFrame:
    """Percentile interval of the mean, resampling groups: each group is drawn a Poisson(1) number of
    times per resample, by a seeded hash, so no rows are copied and resamples add up in one pass.
    Several columns are levels, outer ones first: a member is drawn as often as the product of what
    all levels above it and its own are drawn."""
    levels = [group] if isinstance(group, str) else list(group)
    sums = rows.groupBy(*levels).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    cdf, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cdf.append(total)
    each = sums.select(*levels, "__s", "__n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))

    def drawn(own: list[str]) -> Column:
        name = F.concat_ws("\n", *(F.col(c).cast("string") for c in own), F.col("resample").cast("string"))
        u = F.conv(F.substring(seeded_key(seed, name), 1, 13), 16, 10).cast("double") / float(16**13)
        return F.size(F.filter(F.array(*map(F.lit, cdf)), lambda c: c <= u))

    times = reduce(lambda a, b: a * b, (drawn(levels[: i + 1]) for i in range(len(levels))))
    means = each.groupBy("resample").agg(ratio(F.sum(times * F.col("__s")), F.sum(times * F.col("__n"))).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.avg("mean").alias("mean"))


def decide(figures: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One boolean per gate, and whether all hold."""
    out = figures.withColumns({k: F.coalesce(g, F.lit(False)) for k, g in gates.items()})
    every = F.lit(True)
    for k in gates:
        every = every & F.col(k)
    return out.withColumn("passed", every)


def without_benchmark(rows: DataFrame, hashes: str, benchmark: DataFrame, hash_column: str, *, bits: int | None = None) -> DataFrame:
    """Rows of which no content hash is in the benchmark; a null or empty array has none.

    The arrays are tested in place against a Bloom filter of the benchmark, of bounded size. Rows that
    it clears go on where they are; of the few others, which are written down, the hashes are exploded
    and settled by a join, so no row is dropped or kept wrongly however full the filter is.
    """
    known = benchmark.select(F.col(hash_column).alias("__h")).where("__h is not null").distinct()
    bits = bits or bits_for(known.count())
    tested = rows.withColumn("__maybe", any_might(known, "__h", bits, hashes))
    clear = tested.where(~F.col("__maybe")).drop("__maybe")
    suspects = settle(tested.where("__maybe").drop("__maybe").withColumn("__id", F.monotonically_increasing_id()))
    hit = suspects.select("__id", F.explode(hashes).alias("__h")).join(known, "__h", "left_semi").select("__id").distinct()
    return clear.unionByName(suspects.join(hit, "__id", "left_anti").drop("__id"))


def repeats(items: DataFrame, ident: str, times: int = 3, *, seed: str | int = 17) -> DataFrame:
    """Each item `times` times, in a seeded interleaved order."""
    each = items.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("repeat"))
    return each.orderBy(seeded_key(seed, F.concat_ws("\n", F.col(ident).cast("string"), F.col("repeat").cast("string"))), ident, "repeat")
