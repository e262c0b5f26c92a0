"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as
the next stage's docs, so a lost executor costs at most the stage that is running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesseral.llm import exact_dedup, mixing, near_dedup, packing, quality
from tesseral.llm.common import new_path, read_table, remove

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines leave the texts; documents that fail the rules or are depleted go. Null and empty
    texts go, a null source is a host of its own, repeated rows fare alike, no rows give none."""
    return quality.keep_good(docs.select(*COLUMNS))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the smallest doc_id stays, null ids last; of repeated
    rows one. No rows give none."""
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the smallest; a null id counts as a hash of
    its text. Repeated rows fare alike, no rows give none."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated to the target weights and shuffled globally; copies keep their doc_id.
    A null source is a source of its own, a source without text repeats once, no rows give none."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 4096 tokens. A null text is
    empty, each repeated row has pieces of its own, no rows give none."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The last stage's tokenizer and the near-duplicate signatures have no SQL form; tests/llm compare
#: the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes as soon as the next stage's is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
