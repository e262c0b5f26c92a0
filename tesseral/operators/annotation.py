"""The annotation contract: parsing, normalisation, validation, eligibility and captions.

All of it is column expressions over one array of views per row; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The enumerations of the annotation contract.
TILES = ("top_left", "top_right", "bottom_left", "bottom_right")
HORIZONTAL_VIEWS = ("front", "front_three_quarter", "side", "rear_three_quarter", "back", "top", "bottom", "indeterminate")
SIDES = ("left", "right", "neither", "indeterminate")
VERTICAL_ANGLES = ("overhead", "high_angle", "eye_level", "low_angle", "underside", "indeterminate")
LATERAL = ("front_three_quarter", "side", "rear_three_quarter")
VIEW_KEYS = ("tile", "horizontal_view", "side", "vertical_angle", "framing", "visible_features", "confidence")
ENUMS = {"tile": TILES, "horizontal_view": HORIZONTAL_VIEWS, "side": SIDES, "vertical_angle": VERTICAL_ANGLES}

VIEW = "struct<tile:string,horizontal_view:string,side:string,vertical_angle:string,framing:string,visible_features:array<string>,confidence:double>"
NONE = "array<string>"


def _none() -> Column:
    return F.array().cast(NONE)


def normalise_view(v: Column) -> Column:
    """A lateral view without a side is indeterminate in both."""
    unsure = v["horizontal_view"].isin(*LATERAL) & v["side"].isin("neither", "indeterminate")
    maybe = lambda f: F.when(unsure, F.lit("indeterminate")).otherwise(v[f]).alias(f)
    return F.struct(v["tile"].alias("tile"), maybe("horizontal_view"), maybe("side"), *(v[f].alias(f) for f in VIEW_KEYS[3:]))


def normalise(views: Column) -> Column:
    return F.transform(views, normalise_view)


def side_error(v: Column) -> Column:
    """The first rule between view and side that is broken, or null."""
    h, s = v["horizontal_view"], v["side"]
    return (
        F.when(h.isin(*LATERAL) & ~s.isin("left", "right"), F.concat(F.lit("side must be left or right for "), h))
        .when(h.isin("front", "back", "top", "bottom") & (s != "neither"), F.concat(F.lit("side must be neither for "), h))
        .when((h == "indeterminate") & (s != "indeterminate"), F.lit("side must be indeterminate when horizontal_view is indeterminate"))
    )


def view_errors(v: Column, i: Column) -> Column:
    """Errors of a typed view, located; the side rules only apply where all fields are valid."""
    at = F.concat(F.lit("views."), i.cast("string"))
    named = lambda f, text: F.concat(at, F.lit(f".{f}: {text}"))
    fields = [F.when(~F.coalesce(v[f].isin(*values), F.lit(False)), named(f, "Input should be one of the listed values")) for f, values in ENUMS.items()]
    fields.append(F.when(F.coalesce(strip(v["framing"]), F.lit("")) == "", named("framing", "String should have at least 1 character")))
    no_features = F.coalesce(F.size(v["visible_features"]), F.lit(0)) < 1
    blank = F.coalesce(F.exists(v["visible_features"], lambda x: F.coalesce(strip(x), F.lit("")) == ""), F.lit(False))
    fields.append(F.when(no_features, named("visible_features", "List should have at least 1 item")).when(blank, named("visible_features", "String should have at least 1 character")))
    c = v["confidence"]
    fields.append(
        F.when(c.isNull() | F.isnan(c), named("confidence", "Input should be a finite number"))
        .when(c < 0, named("confidence", "Input should be greater than or equal to 0"))
        .when(c > 1, named("confidence", "Input should be less than or equal to 1"))
    )
    own = F.array_compact(F.array(*fields))
    side = side_error(v)
    return F.when(F.size(own) > 0, own).when(side.isNotNull(), F.array(F.concat(at, F.lit(": Value error, "), side))).otherwise(_none())


def errors(summary: Column, views: Column) -> Column:
    """All errors of a typed annotation, in the contract's order."""
    top = F.when(F.coalesce(strip(summary), F.lit("")) == "", F.array(F.lit("object_summary: String should have at least 1 character"))).otherwise(_none())
    each = F.flatten(F.transform(views, view_errors))
    count = F.when(views.isNull(), F.lit("views: Field required")).when(F.size(views) < 4, F.lit("views: List should have at least 4 items")).when(F.size(views) > 4, F.lit("views: List should have at most 4 items"))
    tiles = F.transform(views, lambda v: v["tile"])
    order = F.when(F.size(F.array_distinct(tiles)) < 4, F.lit("Value error, view tile values must be unique")).when(
        tiles != F.array(*map(F.lit, TILES)), F.lit("Value error, views must use canonical tile order")
    )
    item = F.coalesce(each, _none())
    rest = F.when(F.size(item) > 0, item).when(count.isNotNull(), F.array(count)).when((F.size(top) == 0) & order.isNotNull(), F.array(order)).otherwise(_none())
    return F.concat(top, rest)


def parse(raw: Column) -> dict[str, Column]:
    """Columns from response text: parse_errors (strict types and keys that a typed struct cannot
    show) and annotation, whose values are read only once the types hold. Numbers as strings, unknown
    keys and non-finite numbers are errors, not silently taken."""
    variant = F.try_parse_json(raw)
    root_keys = F.json_object_keys(raw)
    not_json = variant.isNull()
    missing = lambda want, have, at: F.transform(F.array_except(F.array(*map(F.lit, want)), have), lambda k: F.concat(at, k, F.lit(": Field required")))
    extra = lambda want, have, at: F.transform(F.array_except(have, F.array(*map(F.lit, want))), lambda k: F.concat(at, k, F.lit(": Extra inputs are not permitted")))
    typed = F.from_json(raw, f"object_summary string, views array<{VIEW}>")
    items = F.from_json(F.get_json_object(raw, "$.views"), "array<string>")

    def item_errors(text: Column, i: Column) -> Column:
        at = F.concat(F.lit("views."), i.cast("string"), F.lit("."))
        have = F.coalesce(F.json_object_keys(text), _none())
        v = F.try_parse_json(text)
        kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
        wrong = [
            F.when(F.array_contains(have, f) & (F.coalesce(kind(f), F.lit("VOID")) != "STRING"), F.concat(at, F.lit(f"{f}: Input should be a valid string")))
            for f in VIEW_KEYS[:5]
        ]
        features = F.coalesce(kind("visible_features"), F.lit("VOID"))
        wrong.append(F.when(F.array_contains(have, "visible_features") & ~features.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.concat(at, F.lit("visible_features: Input should be a valid list of strings"))))
        number = F.coalesce(kind("confidence"), F.lit("VOID"))
        wrong.append(F.when(F.array_contains(have, "confidence") & ~number.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.concat(at, F.lit("confidence: Input should be a valid number"))))
        return F.when(F.json_object_keys(text).isNull(), F.array(F.concat(F.lit("views."), i.cast("string"), F.lit(": Input should be a valid dictionary")))).otherwise(
            F.concat(missing(VIEW_KEYS, have, at), F.array_compact(F.array(*wrong)), extra(VIEW_KEYS, have, at))
        )

    summary_kind = F.coalesce(F.schema_of_variant(F.try_variant_get(variant, "$.object_summary", "variant")), F.lit("VOID"))
    views_kind = F.coalesce(F.schema_of_variant(F.try_variant_get(variant, "$.views", "variant")), F.lit("VOID"))
    shape = F.concat(
        missing(("object_summary", "views"), root_keys, F.lit("")),
        F.array_compact(
            F.array(
                F.when(F.array_contains(root_keys, "object_summary") & (summary_kind != "STRING"), F.lit("object_summary: Input should be a valid string")),
                F.when(F.array_contains(root_keys, "views") & ~views_kind.startswith("ARRAY"), F.lit("views: Input should be a valid list")),
            )
        ),
        extra(("object_summary", "views"), root_keys, F.lit("")),
        F.when(views_kind.startswith("ARRAY"), F.coalesce(F.flatten(F.transform(items, item_errors)), _none())).otherwise(_none()),
    )
    found = F.when(raw.isNull() | not_json, F.array(F.lit("response is not valid JSON: it cannot be parsed"))).when(root_keys.isNull(), F.array(F.lit("Input should be a valid dictionary"))).otherwise(shape)
    return {"parse_errors": found, "annotation": F.when(F.size(found) == 0, typed)}


def parsed(rows: DataFrame, raw: str = "raw_response_text") -> DataFrame:
    """Adds annotation (views normalised) and validation_errors to response texts."""
    columns = parse(F.col(raw))
    out = rows.withColumn("__parse", columns["parse_errors"]).withColumn("__a", columns["annotation"])
    views = normalise(F.col("__a.views"))
    found = F.when(F.size("__parse") > 0, F.col("__parse")).otherwise(errors(F.col("__a.object_summary"), views))
    annotation = F.when(F.col("__a").isNotNull(), F.struct(strip(F.col("__a.object_summary")).alias("object_summary"), views.alias("views")))
    return out.withColumn("annotation", annotation).withColumn("validation_errors", found).drop("__parse", "__a")


def eligibility_reasons(views: Column) -> Column:
    """'{tile}.{field} is indeterminate', view by view."""
    fields = ("horizontal_view", "side", "vertical_angle")
    one = lambda v: F.array_compact(F.array(*(F.when(v[f] == "indeterminate", F.concat(v["tile"], F.lit(f".{f} is indeterminate"))) for f in fields)))
    return F.flatten(F.transform(views, one))


def viewpoint(v: Column) -> Column:
    h, side = v["horizontal_view"], F.initcap(v["side"])
    return (
        F.when(h == "side", F.concat(side, F.lit(" side")))
        .when(h == "front_three_quarter", F.concat(F.lit("Front-"), v["side"], F.lit(" three-quarter")))
        .when(h == "rear_three_quarter", F.concat(F.lit("Rear-"), v["side"], F.lit(" three-quarter")))
        .otherwise(F.initcap(h))
    )


def vertical_phrase(v: Column) -> Column:
    a = v["vertical_angle"]
    return F.when(a == "high_angle", "high angle").when(a == "eye_level", "eye-level").when(a == "low_angle", "low angle").otherwise(a)


def caption(summary: Column, views: Column) -> Column:
    """The deterministic caption of an eligible annotation; null for any other."""
    one = lambda v: F.concat(
        F.lit("["), F.upper(F.replace(v["tile"], F.lit("_"), F.lit("-"))), F.lit("] "), viewpoint(v), F.lit(", "), vertical_phrase(v), F.lit("; "),
        F.array_join(F.transform(v["visible_features"], strip), ", "),
    )
    text = F.concat(F.lit("[FOUR-VIEWS] Four views of "), strip(summary), F.lit("; "), F.array_join(F.transform(views, one), "; "), F.lit("."))
    return F.when(F.size(eligibility_reasons(views)) == 0, text)


def identity_caption(summary: Column, views: Column) -> Column:
    """Object summary and visible features only, tile by tile."""
    one = lambda v: F.concat(F.lit("["), F.upper(F.replace(v["tile"], F.lit("_"), F.lit("-"))), F.lit("] "), F.array_join(F.transform(v["visible_features"], strip), ", "))
    return F.concat(F.lit("[FOUR-VIEWS] Four views of "), strip(summary), F.lit("; "), F.array_join(F.transform(views, one), "; "), F.lit("."))


#: Words by which a caption would tell the pose.
POSE_WORDS = r"(?i)\b(front|back|rear|side|top|bottom|left|right|three-quarter|overhead|underside|eye-level|high angle|low angle|indeterminate)\b"


def exported(rows: DataFrame, policy: str, *, threshold: float = 0.0, summary: str = "object_summary", views: str = "views") -> DataFrame:
    """`rows` that an export policy lets through. `benchmark` keeps all. `pose` wants every pose field
    determinate and every view's confidence at the calibrated threshold at least. `identity` adds
    identity_caption and export_error, which tells where it has a pose word beside the tiles' names."""
    if policy == "benchmark":
        return rows
    if policy == "pose":
        sure = F.forall(views, lambda v: F.coalesce(v["confidence"] >= threshold, F.lit(False)))
        return rows.where((F.size(eligibility_reasons(F.col(views))) == 0) & sure)
    if policy != "identity":
        raise ValueError(f"unknown export policy {policy}")
    text = identity_caption(F.col(summary), F.col(views))
    told = F.regexp_replace(text, r"\[[A-Z-]+\]", "").rlike(POSE_WORDS)
    return rows.withColumn("identity_caption", text).withColumn("export_error", F.when(told, F.lit("the caption tells the pose")))


def routed(rows: DataFrame, summary: str = "object_summary", views: str = "views") -> DataFrame:
    """Adds validation_errors, rejection_reasons, outcome (failed, abstention or accepted) and caption."""
    out = rows.withColumn("validation_errors", errors(F.col(summary), F.col(views))).withColumn("rejection_reasons", eligibility_reasons(F.col(views)))
    outcome = F.when(F.size("validation_errors") > 0, "failed").when(F.size("rejection_reasons") > 0, "abstention").otherwise("accepted")
    out = out.withColumn("outcome", outcome)
    return out.withColumn("caption", F.when(F.col("outcome") == "accepted", caption(F.col(summary), F.col(views))))


def with_skipped(rows: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """(key, outcome, reasons) of every instance: the routed ones, with their errors or reasons, and the
    groups (key, reason) that were skipped before they had an annotation."""
    why = F.when(F.col("outcome") == "failed", F.col("validation_errors")).otherwise(F.col("rejection_reasons"))
    own = rows.select(key, "outcome", F.array_join(why, "; ").alias("reasons"))
    return own.unionByName(skipped.select(key, F.lit("skipped").alias("outcome"), F.col("reason").alias("reasons")))


def outcome_counters(rows: DataFrame, outcome: str = "outcome", per_accepted: int = 4) -> DataFrame:
    """One row: used, images, ambiguous, skipped, failed."""
    n = lambda name: F.count_if(F.col(outcome) == name).cast("long")
    return rows.agg(n("accepted").alias("used"), (n("accepted") * per_accepted).alias("images"), n("abstention").alias("ambiguous"), n("skipped").alias("skipped"), n("failed").alias("failed"))
