"""Writers: manifests as JSON lines with sorted keys, scorecards as CSV, routed tables, chunk files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import snapshots


def canonical_json(row: Column) -> Column:
    """JSON with sorted keys at every level, ', ' and ': ', ASCII only and nulls kept, as manifests
    that are compared byte by byte need it. to_json has another form, hence a vectorised function."""

    @F.pandas_udf("string")
    def render(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True))

    return render(F.to_json(row, {"ignoreNullFields": "false"}))


def write_manifest(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rewrites the manifest as a whole, in order. Files follow the ranges of the order; together, in
    order of their names, they are the manifest."""
    ordered = rows.orderBy(*order)
    ordered.select(canonical_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(path)


def write_routed(rows: DataFrame, path: str) -> None:
    """One table by outcome, rewritten as a whole. An instance has one outcome, so it cannot linger in
    another one."""
    rows.write.mode("overwrite").partitionBy("outcome").parquet(path)


def route(rows: DataFrame, path: str, *, key: str = "instance", removed: DataFrame | None = None) -> int:
    """Takes instances with their outcomes into the routed table: each leaves the outcome that it had,
    and the parts without any of them are not written. Readers see all of it or nothing (see
    `snapshots`). Gives the version."""
    return snapshots.upsert(rows, path, key=key, route="outcome", removed=removed)


def routed(spark: SparkSession, path: str, outcome: str | None = None, version: int | None = None) -> DataFrame:
    """The instances of the routed table, those of one outcome from its files only."""
    rows = snapshots.read(spark, path, version)
    return rows if outcome is None else rows.where(F.col("outcome") == outcome)


def write_routed_manifests(spark: SparkSession, path: str, manifests: dict[str, str], order: list[str], version: int | None = None) -> int:
    """Rewrites the manifest of each outcome (outcome to path), all from one snapshot of the table;
    columns that are null throughout an outcome are left out of its manifest. Gives the version."""
    at = version or snapshots.versions(spark, path)[-1]
    for outcome, target in manifests.items():
        rows = routed(spark, path, outcome, at).drop("outcome")
        filled = rows.agg(*(F.count(F.col(c)).alias(c) for c in rows.columns)).first()
        write_manifest(rows.select(*(c for c in rows.columns if filled[c] or c in order)), target, order)
    return at


def write_chunks(rows: DataFrame, path: str, value: str = "value") -> None:
    """Request files by chunk, each in the order of ordinal."""
    rows.repartition("chunk").sortWithinPartitions("chunk", "ordinal").select("chunk", F.col(value).alias("value")).write.mode("overwrite").partitionBy("chunk").text(path)


def write_scorecard(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header, quotes doubled, CRLF and blank score fields."""
    ordered = rows.orderBy(*order)
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def append_records(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends a batch of records, so that what is done shows if a later batch fails. A batch with a
    name replaces what an earlier attempt at it has left."""
    if batch is None:
        rows.write.mode("append").json(path)
    else:
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")
