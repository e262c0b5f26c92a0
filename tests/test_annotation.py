import copy
import json

import pytest
from pyspark.sql import functions as F

from tesseral.operators import annotation as A


def view(tile, hv, side, va, *features):
    return {"tile": tile, "horizontal_view": hv, "side": side, "vertical_angle": va, "framing": "full object", "visible_features": list(features), "confidence": 0.9}


def valid():
    return {
        "object_summary": " red kettle ",
        "views": [
            view("top_left", "front_three_quarter", "right", "low_angle", "spout", "lid"),
            view("top_right", "side", "right", "underside", "handle"),
            view("bottom_left", "front", "neither", "high_angle", "logo"),
            view("bottom_right", "rear_three_quarter", "right", "overhead", "seam", "base"),
        ],
    }


def run(spark, *texts):
    rows = A.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_response_text string"))
    rows = rows.withColumn("caption", A.caption(F.col("annotation.object_summary"), F.col("annotation.views")))
    rows = rows.withColumn("reasons", A.eligibility_reasons(F.col("annotation.views")))
    return [r for r in rows.orderBy("i").collect()]


def test_caption_of_a_valid_annotation(spark):
    [r] = run(spark, json.dumps(valid()))
    assert r.validation_errors == [] and r.reasons == []
    assert r.caption == (
        "[FOUR-VIEWS] Four views of red kettle; [TOP-LEFT] Front-right three-quarter, low angle; spout, lid; "
        "[TOP-RIGHT] Right side, underside; handle; [BOTTOM-LEFT] Front, high angle; logo; [BOTTOM-RIGHT] Rear-right three-quarter, overhead; seam, base."
    )


def changed(f):
    a = copy.deepcopy(valid())
    f(a)
    return json.dumps(a)


CASES = [
    (lambda a: a["views"].pop(), "at least 4 items"),
    (lambda a: a["views"][1].update(tile="top_left"), "must be unique"),
    (lambda a: a["views"].reverse(), "canonical tile order"),
    (lambda a: a["views"][0].update(vertical_angle="sideways"), "Input should be"),
    (lambda a: a["views"][2].update(side="left"), "side must be neither for front"),
    (lambda a: a["views"][2].update(horizontal_view="indeterminate"), "side must be indeterminate when"),
    (lambda a: a["views"][0].update(confidence=1.5), "less than or equal to 1"),
    (lambda a: a["views"][0].update(confidence="0.9"), "valid number"),
    (lambda a: a["views"][0].update(confidence=True), "valid number"),
    (lambda a: a["views"][0].pop("framing"), "framing: Field required"),
    (lambda a: a["views"][0].update(extra=1), "Extra inputs"),
    (lambda a: a["views"][0].update(visible_features=[]), "visible_features"),
    (lambda a: a["views"][0].update(visible_features=[" "]), "visible_features"),
    (lambda a: a["views"][0].update(framing=5), "valid string"),
    (lambda a: a.update(object_summary="  "), "object_summary"),
    (lambda a: a.pop("object_summary"), "object_summary: Field required"),
    (lambda a: a.update(more=1), "Extra inputs"),
    (lambda a: a.update(views="no"), "valid list"),
    (lambda a: a["views"].__setitem__(0, 3), "valid dictionary"),
]


def test_each_broken_rule_is_named(spark):
    got = run(spark, *(changed(f) for f, _ in CASES))
    for r, (_, fragment) in zip(got, CASES):
        assert any(fragment in e for e in r.validation_errors), (fragment, r.validation_errors)
    bad = run(spark, "not json", None, "[1]", "")
    assert all(r.validation_errors for r in bad) and "not valid JSON" in bad[0].validation_errors[0]


def test_lateral_view_without_side_becomes_indeterminate(spark):
    [r] = run(spark, changed(lambda a: a["views"][1].update(side="neither")))
    assert r.validation_errors == [] and r.caption is None
    assert r.reasons == ["top_right.horizontal_view is indeterminate", "top_right.side is indeterminate"]


@pytest.mark.parametrize("n", [1, 0])
def test_integer_confidence_is_a_number(spark, n):
    [r] = run(spark, changed(lambda a: a["views"][0].update(confidence=n)))
    assert r.validation_errors == []
