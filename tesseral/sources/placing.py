"""Files copied or moved by tasks, as a data source that rows of (source, target) are written to.

A task writes each file beside its target and renames it there, so a target is whole or absent; before
that it notes the target in a journal. If the job is given up, that is marked, and whatever the journals
name goes (moved files go back). A task that still runs looks for the mark before and after each file: what
it makes after the journals were read it undoes itself. Outcomes come as rows: the tasks write them down,
and those of tasks that count stay.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..plans.working import new_path, remove
from .places import BLOCK, digest, located, there

FORMAT = "tesseral-files"
OUTCOMES = "source string, target string, outcome string, sha256 string"
#: Seconds after which tasks of a job that is given up have ended, and the journals are read again.
LAST_TASKS_S = 3.0


def _copied(at, path: str, to, goal: str) -> str:
    """Copies a file beside its target; gives its name there."""
    folder = goal.rpartition("/")[0]
    to.create_dir(folder, recursive=True)
    beside = f"{folder}/.{uuid.uuid4().hex}"
    with at.open_input_stream(path) as f, to.open_output_stream(beside) as g:
        while block := f.read(BLOCK):
            g.write(block)
    return beside


def _undo(source: str, target: str, move: bool) -> None:
    """Takes a placed file away, and back to its source if it was moved. Another one may be doing the same."""
    (at, path), (to, goal) = located(source), located(target)
    with contextlib.suppress(FileNotFoundError):
        if there(to, goal):
            if move and not there(at, path):
                at.move(_copied(to, goal, at, path), path)
            to.delete_file(goal)


@dataclass
class Placed(WriterCommitMessage):
    """A task that counts: its file of outcomes."""

    name: str


class _Writer(DataSourceWriter):
    def __init__(self, report: str, move: bool):
        self.report, self.move = report, move

    def write(self, iterator: Iterator[Row]) -> Placed:
        files, report = located(self.report)
        name = uuid.uuid4().hex
        for folder in ("outcomes", "journal"):
            files.create_dir(f"{report}/{folder}", recursive=True)
        with files.open_output_stream(f"{report}/journal/{name}.jsonl") as journal, files.open_output_stream(f"{report}/outcomes/{name}.json") as out:
            for row in iterator:
                outcome, sha = self._place(row["source"], row["target"], journal)
                out.write((json.dumps({"source": row["source"], "target": row["target"], "outcome": outcome, "sha256": sha}) + "\n").encode())
        return Placed(name)

    def _place(self, source: str, target: str, journal) -> tuple[str, str | None]:
        (at, path), (to, goal) = located(source), located(target)
        if source == target:
            return "same", digest(at, path)
        if not there(at, path):
            return "no source", None
        sha = digest(at, path)
        if there(to, goal):
            # a file that this job's lost attempt has moved or copied has these bytes, too
            return ("same" if digest(to, goal) == sha else "conflict"), sha
        beside = _copied(at, path, to, goal)
        try:
            if digest(to, beside) != sha:
                raise OSError(f"{source} changed while it was copied")
            journal.write((json.dumps({"source": source, "target": target}) + "\n").encode())
            journal.flush()
            self._go_on()
        except BaseException:
            to.delete_file(beside)
            raise
        to.move(beside, goal)
        if self.move:
            at.delete_file(path)
        try:
            self._go_on()
        except InterruptedError:
            _undo(source, target, self.move)
            raise
        return ("moved" if self.move else "copied"), sha

    def _go_on(self) -> None:
        files, report = located(self.report)
        if there(files, f"{report}/aborted"):
            raise InterruptedError("the job has been given up")

    def commit(self, messages: list[Placed | None]) -> None:
        files, report = located(self.report)
        from pyarrow import fs

        mine = {f"{m.name}.json" for m in messages if m}
        for info in files.get_file_info(fs.FileSelector(f"{report}/outcomes", allow_not_found=True)):
            if info.base_name not in mine:  # of attempts that do not count
                files.delete_file(info.path)

    def abort(self, messages: list[Placed | None]) -> None:
        files, report = located(self.report)
        from pyarrow import fs

        files.create_dir(report, recursive=True)
        with files.open_output_stream(f"{report}/aborted"):
            pass
        for pause in (0.0, LAST_TASKS_S):
            time.sleep(pause)
            for info in files.get_file_info(fs.FileSelector(f"{report}/journal", allow_not_found=True)):
                with files.open_input_stream(info.path) as f:
                    lines = f.read().decode().split("\n")[:-1]
                for line in reversed(lines):
                    entry = json.loads(line)
                    _undo(entry["source"], entry["target"], self.move)


class FilePlaces(DataSource):
    """The data source of (source, target) rows; options `report`, a folder, and `move`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["report"], self.options.get("move", "false") == "true")


def _written(rows: DataFrame, report: str, move: bool) -> DataFrame:
    spark = rows.sparkSession
    spark.dataSource.register(FilePlaces)
    for own in ("journal", "outcomes", "aborted"):  # an earlier job's are settled
        remove(spark, f"{report}/{own}")
    rows.select("source", "target").write.format(FORMAT).option("report", report).option("move", str(move).lower()).mode("append").save()
    return spark.read.schema(OUTCOMES).json(f"{report}/outcomes")


def _distinct(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per target, that of the least source, and the others."""
    rows = plan.select("source", "target").distinct()
    first = rows.groupBy("target").agg(F.min("source").alias("source")).select("source", "target")
    return first, rows.join(first, ["source", "target"], "left_anti")


def copy_files(plan: DataFrame, report: str | None = None) -> DataFrame:
    """Copies the files of a plan (source and target URIs) in tasks and gives (source, target, outcome,
    sha256): `copied`; `same`, the target has these bytes already; `conflict`, it has others and stays;
    `no source`; `target taken`, for a target that a lesser source of the plan has. Nothing is ever
    overwritten. A job that fails leaves none of the files that it has made, and a repeated one finds
    what is there the same. `report` is a folder for the outcomes that all executors share."""
    spark = plan.sparkSession
    report = report or new_path(spark, "-report")
    first, others = _distinct(plan)
    done = _written(first, report, False)
    return done.unionByName(others.select("source", "target", F.lit("target taken").alias("outcome"), F.lit(None).cast("string").alias("sha256")))


def move_files(plan: DataFrame, report: str | None = None) -> DataFrame:
    """Moves the files of a plan, with the outcomes of `copy_files` (`moved` for `copied`; a `conflict`
    leaves its source where it was).

    A target may be the source of another row, as in renumbering a folder: then all such files first
    leave their names for others of their own, and take their targets when all have done so."""
    spark = plan.sparkSession
    report = report or new_path(spark, "-report")
    first, others = _distinct(plan.where("source <> target"))
    stays = plan.where("source = target").select("source", "target").distinct()
    mark = F.concat(F.regexp_extract("target", "^(.*/)", 1), F.lit(f".{uuid.uuid4().hex}-"), F.sha2("target", 256))
    steps = first.select("source", "target", mark.alias("via"))
    left = _written(steps.select("source", F.col("via").alias("target")), f"{report}/left", True)
    away = left.select("source", F.col("target").alias("via"), F.col("outcome").alias("__o"), "sha256").join(steps.select("source", "target", "via"), ["source", "via"])
    on_way = away.where("__o = 'moved'")
    came = _written(on_way.select(F.col("via").alias("source"), "target"), f"{report}/came", True)
    came = came.select(F.col("source").alias("via"), F.col("outcome").alias("__c")).join(on_way, "via")
    back = came.where("__c <> 'moved'").select(F.col("via").alias("source"), F.col("source").alias("target"))
    _written(back, f"{report}/back", True)  # what cannot have its target goes back
    columns = lambda rows, outcome: rows.select("source", "target", outcome.alias("outcome"), "sha256")
    nothing = F.lit(None).cast("string").alias("sha256")
    return (
        columns(came, F.col("__c")).unionByName(columns(away.where("__o <> 'moved'"), F.col("__o")))
        .unionByName(others.select("source", "target", F.lit("target taken").alias("outcome"), nothing))
        .unionByName(stays.select("source", "target", F.lit("same").alias("outcome"), nothing))
    )


def clear_report(spark: SparkSession, report: str) -> None:
    remove(spark, report)



