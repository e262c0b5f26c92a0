import pytest

from tesseral.functions.schema import inlined
from tesseral.operators import evaluation


def test_references_are_inlined():
    schema = {
        "title": "T", "type": "object", "additionalProperties": False,
        "$defs": {"V": {"title": "V", "type": "object", "properties": {"title": {"$ref": "#/$defs/E"}}}, "E": {"enum": ["a", "b"], "title": "E"}},
        "properties": {"views": {"type": "array", "items": {"$ref": "#/$defs/V"}}},
    }
    want = {"type": "object", "properties": {"title": {"enum": ["a", "b"]}}}
    assert inlined(schema) == {"type": "object", "properties": {"views": {"type": "array", "items": want}}}
    with pytest.raises(ValueError):
        inlined({"$defs": {"A": {"items": {"$ref": "#/$defs/A"}}}, "$ref": "#/$defs/A"})


def test_prompts_get_the_leading_tag(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a cup",), ("[FOUR-VIEWS] a cup",)], "p string")
    assert {r[0] for r in df.select(evaluation.tagged(F.col("p"))).collect()} == {"[FOUR-VIEWS] a cup"}
