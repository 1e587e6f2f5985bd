"""Small inputs beside the facts: unified diffs, ownership rules, configuration, schedules."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import glob_regex

RANGES = "path string, old_path string, low int, high int, is_new boolean, is_deleted boolean, is_binary boolean"
SCHEDULES = "ruleName string, scheduleExpression string, targetType string, targetName string, state string, source string"
#: Tuning profiles of a trace: depth, nodes, whether calls resolved by guess count, which of their targets a walk goes on from, and for smart at most how
#: many calls those may have. Fixed values.
PROFILES = {
    "fast": {"depth": 4, "nodes": 2_000, "resolve": False, "expand": "leaf", "calls": 0},
    "balanced": {"depth": 4, "nodes": 2_000, "resolve": True, "expand": "smart", "calls": 12},
    "deep": {"depth": 5, "nodes": 5_000, "resolve": True, "expand": "full", "calls": 0},
}


class DiffError(ValueError):
    pass


@dataclass
class FileDiff:
    path: str
    old_path: str
    is_new: bool = False
    is_deleted: bool = False
    is_binary: bool = False
    hunks: list[tuple[int, int, list[tuple[str, str]]]] = field(default_factory=list)

    def ranges(self) -> list[tuple[int, int]]:
        """Changed lines of the file as it was; an insertion touches the line before it."""
        out = []
        for start, _, lines in self.hunks:
            at, held = start, []
            for op, _ in lines:
                if op == "-":
                    held.append(at)
                elif op == "+":
                    held.append(max(1, at - 1))
                at += op in " -"
            if held:
                out.append((min(held), max(held)))
        return out


def parse_diff(text: str) -> list[FileDiff]:
    """Files of a unified diff. A hunk must hold exactly the lines its header counts."""
    out: list[FileDiff] = []
    lines = text.split("\n")
    k = 0
    clean = lambda p: None if p == "/dev/null" else re.sub("^[ab]/", "", p)
    while k < len(lines):
        line = lines[k]
        if m := re.match(r'diff --git "?a/(.+?)"? "?b/(.+?)"?$', line):
            out.append(FileDiff(m[2], m[1]))
        elif line.startswith("new file mode") and out:
            out[-1].is_new = True
        elif line.startswith("deleted file mode") and out:
            out[-1].is_deleted = True
        elif (line.startswith("Binary files ") or line == "GIT binary patch") and out:
            out[-1].is_binary = True
        elif line.startswith("--- ") and k + 1 < len(lines) and lines[k + 1].startswith("+++ "):
            old, new = (clean(x[4:].split("\t")[0]) for x in (line, lines[k + 1]))
            if not out or out[-1].hunks or (new or old) not in (out[-1].path, out[-1].old_path):
                out.append(FileDiff(new or old or "", old or new or ""))
            out[-1].is_new |= old is None
            out[-1].is_deleted |= new is None
            k += 1
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            if not out:
                raise DiffError(f"line {k + 1}: a hunk without a file")
            old_left, new_left = int(m[2] or 1), int(m[4] or 1)
            held: list[tuple[str, str]] = []
            while old_left or new_left:
                k += 1
                if k >= len(lines):
                    raise DiffError("the diff ends inside a hunk")
                op = lines[k][:1] or " "
                if op == "\\":
                    continue
                if op not in " -+":
                    raise DiffError(f"line {k + 1}: not a line of a hunk")
                old_left, new_left = old_left - (op in " -"), new_left - (op in " +")
                if old_left < 0 or new_left < 0:
                    raise DiffError(f"line {k + 1}: more lines than the hunk counts")
                held.append((op, lines[k][1:]))
            out[-1].hunks.append((int(m[1]), int(m[3]), held))
        k += 1
    return out


def diff_ranges(spark: SparkSession, text: str) -> DataFrame:
    """Changed ranges of a diff's files; files without any stand with null ranges."""
    rows = []
    for f in parse_diff(text):
        for low, high in f.ranges() or [(None, None)]:
            rows.append((f.path, f.old_path, low, high, f.is_new, f.is_deleted, f.is_binary))
    return spark.createDataFrame(rows, RANGES)


def diff_table(diffs: DataFrame) -> DataFrame:
    """Changed lines (file, op, text, low, high) of diffs (diff), each a whole unified diff, parsed where they lie; low and high: the hunk's range."""
    schema = "file string, op string, text string, low int, high int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                for f in parse_diff(text or ""):
                    low, high = (f.ranges() or [(None, None)])[0]
                    rows += [(f.path, op, line, low, high) for _, _, lines in f.hunks for op, line in lines if op != " "]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 3 + [pa.int32()] * 2, strict=True)], names=["file", "op", "text", "low", "high"])

    return diffs.select("diff").mapInArrow(run, schema)


def diff_lines(text: str) -> list[tuple[str, str, str]]:
    """(file, op, line) of a diff, context aside."""
    return [(f.path, op, line) for f in parse_diff(text) for _, _, lines in f.hunks for op, line in lines if op != " "]


def parse_owners(text: str) -> list[tuple[int, str, str, list[str]]]:
    """(number, pattern, regular expression, owners) of ownership rules; a rule may name no owner."""
    out = []
    for line in text.split("\n"):
        parts = re.sub(r"(^|\s)#.*$", "", line).split()
        if parts and not parts[0].startswith(("[", "!")):
            out.append((len(out), parts[0], glob_regex(parts[0]), parts[1:]))
    return out


def owners(files: DataFrame, text: str) -> DataFrame:
    """files (path, ...) with the owners of the last rule that covers each; a rule without owners clears them."""
    rules = json.dumps([{"rule": n, "regex": r, "owners": o} for n, _, r, o in parse_owners(text)])
    every = F.from_json(F.lit(rules), "array<struct<rule:int,regex:string,owners:array<string>>>")
    met = F.filter(every, lambda x: F.rlike(F.col("path"), x["regex"]))
    last = F.try_element_at(met, F.lit(-1))
    return files.withColumn("__last", last).select("*", F.col("__last.rule").alias("rule"), F.col("__last.owners").alias("owners")).drop("__last")


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Settings with others laid over them, maps merged and anything else replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load_config(text: str, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """YAML settings over defaults; unknown profiles are refused."""
    try:
        import yaml
    except ModuleNotFoundError as missing:
        raise RuntimeError("reading YAML settings needs PyYAML") from missing

    held = merged(defaults or {"profile": "fast", "repos": {}}, yaml.safe_load(text) or {})
    if held.get("profile", "fast") not in PROFILES:
        raise ValueError(f"unknown profile {held['profile']}")
    return held


def effective(config: dict[str, Any], repo: str) -> dict[str, Any]:
    """The settings of one repository: its own over the general ones."""
    general = {k: v for k, v in config.items() if k != "repos"}
    return merged(general, config.get("repos", {}).get(repo, {}))


def read_schedules(spark: SparkSession, path: str) -> DataFrame:
    """Schedule records of a JSON array. Fields beyond the known ones and repeated (rule, target) pairs are errors."""
    raw = spark.read.option("multiLine", True).json(path)
    known = [x.split(" ")[0] for x in SCHEDULES.split(", ")]
    if extra := sorted(set(raw.columns) - set(known)):
        raise ValueError(f"unknown fields {extra}")
    rows = spark.read.schema(SCHEDULES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if rows.groupBy("ruleName", "targetName").count().filter("count > 1").limit(1).count():
        raise ValueError("a rule and target repeat")
    return rows


def upsert_schedules(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the pairs of new put in; the others stay."""
    kept = stored.join(new.select("ruleName", "targetName"), ["ruleName", "targetName"], "left_anti")
    return kept.select(*stored.columns).unionByName(new.select(*stored.columns))
