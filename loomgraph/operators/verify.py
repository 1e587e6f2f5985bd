"""Change verification: breaking changes, exposures, obligations and the verdict."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import routes
from loomgraph.operators.scope import first_of, overlapping
from loomgraph.operators.search import ranked_window

#: Verdicts from best to worst; rows of an exposure list.
VERDICTS = ("pass", "info", "warn", "fail")
MOST_EXPOSED = 100

_SIGNATURE = re.compile(r"\b([A-Za-z_]\w*)\s*\(([^()]*)\)\s*(?:throws [\w., ]+)?[{:]?\s*$")


def parameters(line: str) -> tuple[str, dict[str, str]] | None:
    """A declaration's name and parameters (name -> type), in either 'type name' or 'name: type' order."""
    found = _SIGNATURE.search(line)
    if not found:
        return None
    out = {}
    for part in filter(None, (p.strip() for p in found[2].split(","))):
        part = re.sub(r"@\w+(\([^)]*\))?\s*", "", part).split("=")[0].strip()
        if ":" in part:
            name, kind = (x.strip() for x in part.split(":", 1))
        else:
            *kind, name = part.split()
            kind = " ".join(kind)
        out[name.rstrip("?")] = kind
    return found[1], out


SIGNATURES = "file string, op string, function string, position int, parameter string, type string"


def signatures(lines: DataFrame) -> DataFrame:
    """Declarations on a diff's changed lines (file, op, text): a row for each parameter, and one without for each declaration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in SIGNATURES.split(", ")]
        for batch in batches:
            rows = []
            for file, op, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = parameters(text or "") if op in ("+", "-") else None
                if held:
                    rows.append((file, op, held[0], -1, None, None))
                    rows += [(file, op, held[0], k, name, kind) for k, (name, kind) in enumerate(held[1].items())]
            if rows:
                types = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return lines.select("file", "op", "text").mapInArrow(run, SIGNATURES)


def breaking_changes(lines: DataFrame) -> DataFrame:
    """Rows (file, function, change, severity, detail) from a diff's changed lines (file, op, text): declarations removed, parameters removed or of
    another type. A declaration that stands on both sides is changed, not removed."""
    found = signatures(lines)
    keys = ["file", "function"]
    new = found.filter("op = '+'")
    old = found.filter("op = '-'")
    kept = new.select(*keys).distinct()
    gone = old.select(*keys).distinct().join(kept, keys, "left_anti").select(*keys, F.lit("endpoint_removed").alias("change"), F.lit("critical").alias("severity"), F.lit("").alias("detail"))
    asked = old.filter("position >= 0").select(*keys, "parameter", F.col("type").alias("before")).distinct().join(kept, keys, "left_semi")
    after = new.filter("position >= 0").groupBy(*keys, "parameter").agg(F.min("type").alias("after"))
    met = asked.join(after, [*keys, "parameter"], "left")
    change = F.when(F.col("after").isNull(), "parameter_removed").when(F.col("after") != F.col("before"), "parameter_type_changed")
    return gone.unionByName(met.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change", F.lit("high").alias("severity"), F.col("parameter").alias("detail")))


def changed_functions(ranges: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions that changed ranges (repo_name, file_path, low, high) touch, and ranges that touch none."""
    met = overlapping(ranges, functions, ["repo_name", "file_path"])
    keys = ["repo_name", "file_path", "low", "high"]
    return met.select("id", "caller_id").distinct(), ranges.join(met.select(*keys).distinct(), keys, "left_anti")


def endpoint_consumers(endpoints: DataFrame, calls: DataFrame, limit: int = MOST_EXPOSED) -> DataFrame:
    """Callers in other repositories of each endpoint, first by repository and caller: (endpoint_id, c_repo, caller_function_id, line, clipped)."""
    left, right, pairs = routes.contract_sides(calls, endpoints, literal=False)
    # endpoints equal in route, method and repository have the same callers, which are found and ranked once
    like = ["e_segs", "e_method", "e_repo"]
    callers = left.groupBy("c_segs", "c_method", "c_repo", "caller_function_id").agg(F.min("line_number").alias("line")).join(pairs, "c_segs")
    met = callers.join(right.select(*like).distinct(), "e_segs").filter(routes.methods_meet(F.col("c_method"), F.col("e_method")) & (F.col("c_repo") != F.col("e_repo")))
    held = met.groupBy(*like, "c_repo", "caller_function_id").agg(F.min("line").alias("line"))
    cut = ranked_window(held, like, ["c_repo", "caller_function_id"], limit + 1)
    many = cut.filter(F.col("rn") > limit).select(*like).distinct().withColumn("clipped", F.lit(True))
    first = cut.filter(F.col("rn") <= limit).drop("rn").join(many, like, "left").fillna(False, ["clipped"])
    return right.join(first, like).select("endpoint_id", "c_repo", "caller_function_id", "line", "clipped")


def entity_exposures(accesses: DataFrame, repo: int) -> DataFrame:
    """Other repositories that read or write what a repository writes."""
    own = accesses.filter((F.col("repo_id") == repo) & (F.lower("access") == "write")).select(F.lower("entity_name").alias("entity")).distinct()
    other = accesses.filter(F.col("repo_id") != repo).select(F.lower("entity_name").alias("entity"), "repo_id", F.lower("access").alias("access"))
    return other.join(own, "entity", "left_semi").distinct()


def verdict(facts: DataFrame) -> DataFrame:
    """facts (change, breaking, consumers, incomplete, obligation, waived) with the worst verdict that holds for each change."""
    bad = F.col("obligation").isin("contradicted", "missing") & ~F.col("waived")
    out = (
        F.when((F.col("breaking") & (F.col("consumers") > 0)) | bad, "fail")
        .when(F.col("breaking") | F.col("incomplete"), "warn")
        .when((F.col("consumers") > 0) | F.col("waived"), "info")
        .otherwise("pass")
    )
    return facts.withColumn("verdict", out)


def overall(verdicts: DataFrame, *keys: str) -> DataFrame:
    """The worst of all verdicts, for each key if any are named; of none, pass."""
    order = F.array(*(F.lit(v) for v in VERDICTS))
    worst = verdicts.groupBy(*keys).agg(F.coalesce(F.max(F.array_position(order, F.col("verdict"))), F.lit(1)).cast("int").alias("worst"))
    return worst.select(*keys, F.element_at(order, F.col("worst")).alias("verdict"))


def obligations(required: DataFrame, observed: DataFrame) -> DataFrame:
    """Required evidence (claim, caller_id) as confirmed, contradicted or missing by what was observed (caller_id, holds)."""
    held = first_of(observed, ["caller_id"], F.col("holds").desc())
    state = F.when(F.col("holds").isNull(), "missing").when(F.col("holds"), "confirmed").otherwise("contradicted")
    return required.join(held, "caller_id", "left").select("claim", "caller_id", state.alias("obligation"))
