"""Run history as six Parquet tables, each partitioned by run.

A run's rows are replaced as a whole by overwriting its partition; the audit log is only added to.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe import model as M

TABLES = ("runs", "issues", "advice", "decisions", "applied_fixes", "audit")
# The states of a run and who may act in it.
STATUSES = ("queued", "analyzing", "awaiting_approval", "applying", "completed", "failed")
ACTORS = ("system", "detector", "ai", "human")
DETAIL_LENGTH = 2_000

_TEXT, _LONG, _INT, _REAL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
RUN_SCHEMA = (
    T.StructType()
    .add("run_id", _TEXT)
    .add("filename", _TEXT)
    .add("status", _TEXT)
    .add("created_at", _TEXT)
    .add("updated_at", _TEXT)
    .add("rows_before", _LONG)
    .add("rows_after", _LONG)
    .add("columns_before", _INT)
    .add("columns_after", _INT)
    .add("score_before", _REAL)
    .add("score_after", _REAL)
    .add("issues_found", _LONG)
    .add("fixes_applied", _LONG)
    .add("provider", _TEXT)
    .add("model", _TEXT)
    .add("llm_calls", _INT)
    .add("prompt_tokens", _LONG)
    .add("completion_tokens", _LONG)
    .add("advice_fallbacks", _INT)
    .add("warnings", T.ArrayType(_TEXT))
    .add("error", _TEXT)
)
# As stored: events of one call share a batch and are numbered in it, so that writers need not know of each other.
AUDIT_SCHEMA = (
    T.StructType()
    .add("run_id", _TEXT)
    .add("batch", _TEXT)
    .add("place", _LONG)
    .add("at", _TEXT)
    .add("actor", _TEXT)
    .add("event", _TEXT)
    .add("detail", _TEXT)
)


def checked_id(run_id: str) -> str:
    """Run ids are folder names, so only letters, digits, _ and - will do."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    return run_id


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


class History:
    """Tables under one folder, which must be one every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _schema(self, table: str) -> T.StructType:
        run = [T.StructField("run_id", T.StringType())]
        return {
            "runs": RUN_SCHEMA,
            "issues": T.StructType(run + [T.StructField("phase", T.StringType())] + M.ISSUE_SCHEMA.fields),
            "advice": T.StructType(run + M.ADVICE_SCHEMA.fields),
            "decisions": T.StructType(
                run + M.DECISION_SCHEMA.fields + [T.StructField("decided_at", T.StringType())]
            ),
            "applied_fixes": T.StructType(
                run + [T.StructField("step", T.IntegerType())] + M.APPLIED_SCHEMA.fields
            ),
            "audit": AUDIT_SCHEMA,
        }[table]

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """One table; with ``run_id`` only that partition is listed and read."""
        schema = self._schema(table)
        if self._exists(self.path(table)):
            df = self.spark.read.schema(schema).parquet(self.path(table))
        else:
            df = self.spark.createDataFrame([], schema)
        df = df.select(*schema.names)
        if table == "audit":
            in_order = Window.partitionBy("run_id").orderBy("at", "batch", "place")
            seq = (F.row_number().over(in_order) - 1).cast("long")
            df = df.select("run_id", seq.alias("seq"), "at", "actor", "event", "detail")
        return df if run_id is None else df.where(F.col("run_id") == run_id)

    def _replace(self, table: str, df: DataFrame, partitions: list[str], folder: str) -> None:
        """Replace one folder by df; the old rows go only once the new ones are written, or are none."""
        if df.isEmpty():
            self._remove(f"{self.path(table)}/{folder}")
            return
        (
            df.select(*self._schema(table).names)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partitions)
            .parquet(self.path(table))
        )

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        files, target = self._hadoop(path)
        return files.exists(target)

    def _remove(self, path: str) -> bool:
        files, target = self._hadoop(path)
        return files.exists(target) and files.delete(target, True)

    # --- writing --------------------------------------------------------------------------------

    def save_run(self, run_id: str, **values) -> None:
        """Create a run, or change some of its fields."""
        current = self.read("runs", checked_id(run_id)).first()
        record = current.asDict() if current else {
            "run_id": run_id,
            "status": "queued",
            "created_at": now(),
            **{f.name: 0 for f in RUN_SCHEMA if isinstance(f.dataType, (T.LongType, T.IntegerType))},
            "score_before": 0.0,
            "score_after": 0.0,
            "warnings": [],
        }
        record |= values
        record["updated_at"] = now()
        if record["status"] not in STATUSES:
            raise ValueError(f"unknown status {record['status']}")
        row = tuple(record.get(n) for n in RUN_SCHEMA.names)
        self._replace("runs", self.spark.createDataFrame([row], RUN_SCHEMA), ["run_id"], f"run_id={run_id}")

    def save_issues(self, run_id: str, issues: DataFrame, phase: str = "before") -> None:
        """Replace the list of one phase as a whole, also by an empty one."""
        folder = f"run_id={checked_id(run_id)}/phase={checked_id(phase)}"
        tagged = issues.withColumns({"run_id": F.lit(run_id), "phase": F.lit(phase)})
        self._replace("issues", tagged, ["run_id", "phase"], folder)

    def save_advice(self, run_id: str, advice: DataFrame) -> None:
        self._replace("advice", advice.withColumn("run_id", F.lit(checked_id(run_id))), ["run_id"], f"run_id={run_id}")

    def save_decisions(self, run_id: str, decisions: list[M.Decision]) -> None:
        df = M.decisions_frame(self.spark, decisions)
        df = df.withColumns({"run_id": F.lit(checked_id(run_id)), "decided_at": F.lit(now())})
        self._replace("decisions", df, ["run_id"], f"run_id={run_id}")

    def save_applied(self, run_id: str, applied: list[M.AppliedFix]) -> None:
        """Replace the change records of a run, also by none."""
        checked_id(run_id)
        schema = self._schema("applied_fixes")
        rows = [
            (run_id, i, *[getattr(fix, n) for n in M.APPLIED_SCHEMA.names]) for i, fix in enumerate(applied)
        ]
        self._replace("applied_fixes", self.spark.createDataFrame(rows, schema), ["run_id"], f"run_id={run_id}")

    def add_events(self, run_id: str, events: list[tuple[str, str, str]]) -> None:
        """Append (actor, event, detail) entries to the audit log, in order.

        ``seq`` is given when the log is read: by time, then by batch, so two writers never share a number.
        """
        at, batch = now(), uuid.uuid4().hex
        rows = [
            (checked_id(run_id), batch, i, at, actor, event, detail[:DETAIL_LENGTH])
            for i, (actor, event, detail) in enumerate(events)
        ]
        if any(r[4] not in ACTORS for r in rows):
            raise ValueError("unknown actor")
        df = self.spark.createDataFrame(rows, AUDIT_SCHEMA)
        df.coalesce(1).write.mode("append").partitionBy("run_id").parquet(self.path("audit"))

    def delete_run(self, run_id: str) -> bool:
        """Remove a run from all tables; False when there was none."""
        folder = f"run_id={checked_id(run_id)}"
        return any([self._remove(f"{self.path(t)}/{folder}") for t in TABLES])

    # --- reading --------------------------------------------------------------------------------

    def audit_log(self, run_id: str) -> DataFrame:
        return self.read("audit", run_id).orderBy("seq")

    def runs(self, limit: int = 50) -> DataFrame:
        return run_list(self.read("runs"), limit)

    def overview(self) -> DataFrame:
        return overview(self.read("runs"))


def run_list(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs first."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def find_run(runs: DataFrame, run_id) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def overview(runs: DataFrame, rounded: bool = True) -> DataFrame:
    """Totals over all runs; the lift counts completed runs only."""
    lift = F.avg(F.when(F.col("status") == "completed", F.col("score_after") - F.col("score_before")))
    lift = F.coalesce(lift, F.lit(0.0))
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("issues_found"), F.lit(0)).alias("issues_found"),
        F.coalesce(F.sum("fixes_applied"), F.lit(0)).alias("fixes_applied"),
        (F.round(lift, 1) if rounded else lift).alias("average_score_lift"),
    )
