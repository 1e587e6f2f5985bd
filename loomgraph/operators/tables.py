"""Sinks and states: snapshot partitions, upserts, append logs, reports and gates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise a step of a walk and cut its lineage: a table written to the shared folder that the session names, or on a single machine (tests)
    to one of our own where it names none. As its size is known, joins with it are broadcast while it is small and shuffled when it is not."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/loomgraph/{spark.sparkContext.applicationId}/walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_snapshot(facts: DataFrame, path: str) -> None:
    """Replace the snapshots that facts hold, and no others."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of new put in by key; a column that is null in new keeps what was stored."""
    values = [c for c in stored.columns if c not in keys]
    old, fresh = stored.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return old.join(fresh, on, "full").select(*(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in values))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def newest(log: DataFrame, time: str, n: int) -> DataFrame:
    return log.orderBy(F.col(time).desc_nulls_last(), *(c for c in log.columns if c != time)).limit(n)


def delete_where(facts: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """facts without the rows whose keys are in gone."""
    return facts.join(gone.select(*keys).distinct(), keys, "left_anti")


def markdown(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """A report: each section a table of its first rows."""
    lines = [f"# {title}", ""]
    for name, rows in sections.items():
        held = rows.limit(most + 1).collect()
        lines += [f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |" for row in held[:most]]
        lines += [f"More than {most} rows." if len(held) > most else "", ""]
    return "\n".join(lines)


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> list[str]:
    """Breaches of limits {column: ('max' or 'min', value)} by a one-row table; a column that is missing or null is a breach."""
    found = metrics.first()
    row = found.asDict() if found else {}
    out = []
    for name, (side, value) in limits.items():
        held = row.get(name)
        if held is None or (held > value if side == "max" else held < value):
            out.append(f"{name} is {held}; {side} {value}")
    return out


def register(spark: SparkSession, facts: dict[str, DataFrame]) -> None:
    for name, df in facts.items():
        df.createOrReplaceTempView(name)
