"""Keyed tables in snapshots: an update rewrites the parts that it touches and is published by one rename.

A table is a folder with `data/write=<id>/bucket=<n>/...`, files that are written once, and
`snapshots/<version>.json`, which says for each bucket whose files count. A snapshot is there as a whole
or not at all, so readers see the old rows or the new ones. Versions are taken by renaming without
overwriting: of two writers one gets the next version; the other rebases what it has written if the
winner has touched other buckets, and else does its update again on the winner's snapshot.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.working import file_system, remove, working, write_new

BUCKETS = 64
#: How often an update that lost the race for its version tries again.
ATTEMPTS = 20


@dataclass(frozen=True)
class Snapshot:
    """version; the key and the routing column; the columns; whose files count in each bucket."""

    version: int
    key: str
    route: str | None
    columns: T.StructType
    writes: dict[int, str]

    def text(self) -> str:
        return json.dumps({"version": self.version, "key": self.key, "route": self.route, "columns": self.columns.jsonValue(), "writes": {str(k): v for k, v in self.writes.items()}})

    @staticmethod
    def of(text: str) -> Snapshot:
        d = json.loads(text)
        return Snapshot(d["version"], d["key"], d["route"], T.StructType.fromJson(d["columns"]), {int(k): v for k, v in d["writes"].items()})


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table that can be read, rising."""
    files, at = file_system(spark, f"{path}/snapshots")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The table's snapshot of a version, the last by default; None if there is none."""
    if version is None:
        every = versions(spark, path)
        if not every:
            return None
        version = every[-1]
    return Snapshot.of(spark.read.text(f"{path}/snapshots/{version:012d}.json", wholetext=True).first()[0])


def _rows(spark: SparkSession, path: str, at: Snapshot, buckets: set[int] | None = None) -> DataFrame:
    """The rows of some buckets, with their bucket."""
    routes = [at.columns[at.route]] if at.route else []
    schema = T.StructType([*(f for f in at.columns if f not in routes), T.StructField("write", T.StringType()), T.StructField("bucket", T.IntegerType()), *routes])
    paths = [f"{path}/data/write={w}/bucket={b}" for b, w in at.writes.items() if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*paths)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a snapshot. A filter on the routing column reads the files of these routes only."""
    at = snapshot(spark, path, version)
    if at is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    return _rows(spark, path, at).select(*at.columns.names)


def _publish(spark: SparkSession, path: str, at: Snapshot) -> bool:
    """Whether the snapshot has become its version; False if another one has."""
    return write_new(spark, f"{path}/snapshots/{at.version:012d}.json", at.text())


def upsert(fresh: DataFrame, path: str, *, key: str, route: str | None = None, removed: DataFrame | None = None) -> int:
    """Takes rows into the table and gives the version that has them. A row replaces that of its key,
    whichever value that had in the column `route`, by which files are kept apart; the keys in `removed` go. Only the buckets of these keys are written.

    `fresh` has one row per key, no null keys; of a key in both, the row stays. New columns are added
    with nulls in older rows. An update without rows publishes nothing. If the writer dies the last
    snapshot stands; what it has written is in no snapshot.
    """
    spark = fresh.sparkSession
    gone = removed.select(key).distinct() if removed is not None else fresh.select(key).limit(0)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")
    with working(spark) as put:
        rows, gone = put(fresh.select("*", bucket)), put(gone.select("*", bucket))
        touched = {r[0] for r in rows.select("bucket").union(gone.select("bucket")).distinct().collect()}
        if not touched:
            return (versions(spark, path) or [0])[-1]
        written, before = "", None
        for _ in range(ATTEMPTS):
            at = snapshot(spark, path)
            mine = {b: at.writes.get(b) for b in touched} if at else dict.fromkeys(touched)
            if not written or mine != before:
                if written:
                    remove(spark, f"{path}/data/write={written}")
                written, before = uuid.uuid4().hex, mine
                table = rows
                if at:
                    known = _rows(spark, path, at, touched).drop("write")
                    stays = known.join(rows.select(key).union(gone.select(key)), key, "left_anti")
                    table = rows.unionByName(stays, allowMissingColumns=True)
                columns = T.StructType([f for f in table.schema if f.name != "bucket"])
                table.repartition("bucket").write.partitionBy("bucket", *([route] if route else [])).parquet(f"{path}/data/write={written}")
                files, place = file_system(spark, f"{path}/data/write={written}")
                full = {int(s.getPath().getName().removeprefix("bucket=")) for s in files.listStatus(place) if s.getPath().getName().startswith("bucket=")}
            others = {b: w for b, w in at.writes.items() if b not in touched} if at else {}
            if at:  # a winner may have added columns
                columns = T.StructType([*columns, *(f for f in at.columns if f.name not in columns.names)])
            if _publish(spark, path, Snapshot(at.version + 1 if at else 1, key, route, columns, others | dict.fromkeys(sorted(full), written))):
                return at.version + 1 if at else 1
    raise RuntimeError(f"{path}: lost the race for a version {ATTEMPTS} times")


def expire(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Deletes all but the last `keep` snapshots and the files that only these needed; gives their
    versions. Files of no snapshot stay, as a writer may be about to publish them."""
    if keep < 1:
        raise ValueError("at least one snapshot must stay")
    every = versions(spark, path)
    needed = {w for v in every[-keep:] for w in snapshot(spark, path, v).writes.values()}
    for v in every[:-keep]:
        writes = set(snapshot(spark, path, v).writes.values())
        remove(spark, f"{path}/snapshots/{v:012d}.json")
        for w in writes - needed:
            remove(spark, f"{path}/data/write={w}")
    return every[:-keep]
