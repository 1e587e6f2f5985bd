"""Call resolution: ordered tiers, of which the first that gives a unique target wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import unresolved_reason
from loomgraph.operators.scope import first_of, unique

#: Source and confidence of each tier, in order: fixed values.
TIERS = [("same_file", "high"), ("qualified_repo", "high"), ("same_class_this", "high"), ("same_class_simple", "high"), ("java_inherited_repo", "medium"), ("unique_repo", "medium")]
#: Language families whose names meet across repositories, and those that fold case: fixed values.
FAMILIES = {"java": "jvm", "kotlin": "jvm", "javascript": "js", "typescript": "js", "vue": "js", "csharp": "dotnet", "go": "go", "sql": "sql", "powershell": "powershell", "rpgle": "ibmi", "sqlrpgle": "ibmi", "clle": "ibmi", "dds": "ibmi"}
FOLDED = ("ibmi", "powershell", "sql")


def class_of(name: Column) -> Column:
    """A function's class: its name without the last part, or the whole name where there is none."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def dotted(name: Column) -> Column:
    return F.contains(name, F.lit("."))


def suffixes(name: Column) -> Column:
    """Dotted suffixes of at least two parts."""
    parts = F.split(name, r"\.")
    at = F.when(F.size(parts) >= 2, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))


def resolve_calls(calls: DataFrame, functions: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """calls (id, caller_function_id, callee_name, is_callback_argument) with callee_function_id, source and confidence.

    functions: identified functions; inherited: (id, target), calls that types.inherited answers, if bases are known. All lookups are unique keys, so every join keeps one row a call; a tier that finds
    several targets falls through to the next.
    """
    own = functions.select(F.col("id").alias("fid"), "file_id", "repo_id", F.coalesce("snapshot_id", F.lit(-1)).alias("snap"), "name", "simple_name", "language")
    scope = ["repo_id", "snap"]
    by_file = unique(own, ["file_id", "name"], "fid", "t1").withColumnRenamed("name", "k1")
    names = own.select(*scope, "fid", F.explode(F.array_distinct(F.concat(F.array("name"), F.when(F.col("language") == "java", suffixes(F.col("name"))).otherwise(F.array().cast("array<string>"))))).alias("k2"))
    by_suffix = unique(names.distinct(), [*scope, "k2"], "fid", "t2")
    by_name = unique(own, [*scope, "name"], "fid", "t3")
    by_simple = unique(own, [*scope, "simple_name"], "fid", "t6").withColumnRenamed("simple_name", "k6")
    caller = own.select(F.col("fid").alias("caller_function_id"), "file_id", *scope, class_of(F.col("name")).alias("cls"))
    callee = F.col("callee_name")
    own_method = F.regexp_extract(callee, r"^this\.([^.]+)$", 1)
    # a call without a tier's key gets one that nothing has, so that such calls are spread and not joined in one place
    none = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string"))
    rows = (
        calls.join(caller, "caller_function_id")
        .withColumn("k1", callee)
        .withColumn("k2", F.when(dotted(callee), callee).otherwise(none))
        .withColumn("k3", F.when(own_method != "", F.concat("cls", F.lit("."), own_method)).otherwise(none))
        .withColumn("k4", F.when(~dotted(callee), F.concat("cls", F.lit("."), callee)).otherwise(none))
        .withColumn("k6", F.when(~dotted(callee), callee).otherwise(none))
        .join(by_file, ["file_id", "k1"], "left")
        .join(by_suffix, [*scope, "k2"], "left")
        .join(by_name.withColumnRenamed("name", "k3"), [*scope, "k3"], "left")
        .join(by_name.select(*scope, F.col("name").alias("k4"), F.col("t3").alias("t4")), [*scope, "k4"], "left")
        .join(by_simple, [*scope, "k6"], "left")
    )
    above = F.lit(None).cast("long").alias("t5")
    rows = rows.select("*", above) if inherited is None else rows.join(inherited.select("id", F.col("target").alias("t5")), "id", "left")
    target = F.coalesce(*(f"t{k}" for k in range(1, len(TIERS) + 1)))
    source, confidence = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in range(len(TIERS), 0, -1):
        source = F.when(F.col(f"t{k}").isNotNull(), TIERS[k - 1][0]).otherwise(source)
        confidence = F.when(F.col(f"t{k}").isNotNull(), TIERS[k - 1][1]).otherwise(confidence)
    out = rows.withColumn("callee_function_id", target).withColumn("source", source).withColumn("confidence", confidence)
    return cap_callbacks(out.select(*calls.columns, "callee_function_id", "source", "confidence"))


def cap_callbacks(calls: DataFrame) -> DataFrame:
    """Resolved calls of callback arguments are never better than low."""
    capped = F.col("is_callback_argument") & F.col("callee_function_id").isNotNull()
    return calls.withColumn("source", F.when(capped, "callback_argument").otherwise(F.col("source"))).withColumn("confidence", F.when(capped, "low").otherwise(F.col("confidence")))


def family(language: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(language)), F.lower(language))


def folded(name: Column, kin: Column) -> Column:
    return F.when(kin.isin(*FOLDED), F.lower(name)).otherwise(name)


def answers_across(unresolved: DataFrame, functions: DataFrame) -> DataFrame:
    """Unresolved calls that a function of another repository and the same language family answers: (id, caller_repo, target, source).

    qualified_workspace: a dotted name unique in the family over all repositories, its declaration elsewhere. unique_workspace: a bare
    name declared exactly once in the family's other repositories.
    """
    own = functions.select(F.col("id").alias("fid"), "repo_id", family(F.col("language")).alias("kin"), "name", "simple_name")
    own = own.withColumn("qualified", folded(F.col("name"), F.col("kin"))).withColumn("simple", folded(F.col("simple_name"), F.col("kin")))
    caller = own.select(F.col("fid").alias("caller_function_id"), F.col("repo_id").alias("caller_repo"), "kin")
    calls = unresolved.join(caller, "caller_function_id").withColumn("key", folded(F.col("callee_name"), F.col("kin")))
    by_name = own.filter(dotted(F.col("qualified"))).groupBy("kin", F.col("qualified").alias("key")).agg(F.count("*").alias("n"), F.min("fid").alias("target"), F.min("repo_id").alias("target_repo")).filter("n = 1").drop("n")
    first = calls.filter(dotted(F.col("key"))).join(by_name, ["kin", "key"]).filter("target_repo <> caller_repo").select("id", "caller_repo", "target", F.lit("qualified_workspace").alias("source"))
    by_repo = own.groupBy("kin", F.col("simple").alias("key"), "repo_id").agg(F.count("*").alias("n"), F.min("fid").alias("fid"))
    # declarations elsewhere are all declarations less the caller's own: no join of a call with every repository
    every = by_repo.groupBy("kin", "key").agg(F.sum("n").alias("all"), F.count("*").alias("repos"), F.sum("fid").alias("fids"))
    bare = calls.filter(~dotted(F.col("key"))).join(every, ["kin", "key"])
    mine = by_repo.select("kin", "key", F.col("repo_id").alias("caller_repo"), F.col("n").alias("own"), F.col("fid").alias("own_fid"))
    bare = bare.join(mine, ["kin", "key", "caller_repo"], "left").filter(F.col("all") - F.coalesce("own", F.lit(0)) == 1)
    second = bare.select("id", "caller_repo", (F.col("fids") - F.coalesce("own_fid", F.lit(0))).alias("target"), F.lit("unique_workspace").alias("source"))
    # a name is dotted or bare, so that a call has one answer at most
    return first.unionByName(second)


def resolve_across(unresolved: DataFrame, functions: DataFrame) -> DataFrame:
    """answers_across by call: (id, target, source)."""
    return first_of(answers_across(unresolved, functions), ["id"], "source", "target").select("id", "target", "source")


def dedupe_calls(calls: DataFrame) -> DataFrame:
    """Identical call records but the one of least id."""
    keyed = calls.withColumn("k_callee", F.coalesce("callee_function_id", F.lit(0))).withColumn("k_line", F.coalesce("line_number", F.lit(-1)))
    return first_of(keyed, ["caller_function_id", "k_callee", "callee_name", "k_line", "is_async", "is_callback_argument"], "id").drop("k_callee", "k_line")


def trace_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """The denormalised call graph: a row for each distinct call record, with the identities of both ends."""
    caller = functions.select(F.col("id").alias("caller_function_id"), "repo_id", "snapshot_id", "caller_id")
    callee = functions.select(F.col("id").alias("callee_function_id"), F.col("caller_id").alias("callee_id"), F.col("repo_name").alias("callee_repo"), F.col("file_path").alias("callee_file"), F.col("name").alias("callee_func"))
    rows = dedupe_calls(calls).join(caller, "caller_function_id").join(callee, "callee_function_id", "left")
    reason = F.when(F.col("callee_id").isNull(), unresolved_reason(F.col("callee_name")))
    return rows.select(
        "id", "repo_id", "snapshot_id", "caller_function_id", "callee_function_id", "caller_id", "callee_id", "callee_name", "callee_repo", "callee_file", "callee_func", "line_number", "source", "confidence", reason.alias("unresolved_reason")
    )


def name_gate(calls: DataFrame, functions: DataFrame, generic: Column) -> DataFrame:
    """Unresolved calls that may become name-based edges: names of three letters, not generic, declared in the caller's file or once in its repository."""
    held = functions.select(F.col("id").alias("caller_function_id"), "file_id", "repo_id")
    in_file = functions.select("file_id", F.col("simple_name").alias("key")).distinct().withColumn("local", F.lit(True))
    in_repo = functions.groupBy("repo_id", F.col("simple_name").alias("key")).agg(F.count("*").alias("declared"))
    rows = calls.join(held, "caller_function_id").withColumn("key", F.substring_index("callee_name", ".", -1))
    rows = rows.join(in_file, ["file_id", "key"], "left").join(in_repo, ["repo_id", "key"], "left")
    ok = (F.length("callee_name") >= 3) & ~generic & (F.coalesce("local", F.lit(False)) | (F.coalesce("declared", F.lit(0)) == 1))
    return rows.filter(ok).select(*calls.columns)


#: Languages of IBM i sources: fixed values.
IBMI = "rpg rpgle sqlrpgle rpgleinc sqlrpgleinc cl clle clp dds dspf pf lf prtf ibmi_binder".split()


def resolve_ibmi(calls: DataFrame, functions: DataFrame, exports: DataFrame, bindings: DataFrame) -> DataFrame:
    """Open calls of IBM i callers answered in order, names in lower case: (id, target, source, confidence).

    Tiers: the same file, a unique simple name in the repository, a full and then a simple name unique over all repositories' IBM i sources, an
    export of another repository, an export that the caller's binding directory names there. exports: (repo_id, export_name, function_id, object_name);
    bindings: (repo_id, file_id, kind ref or entry, binding_name, target_object).
    """
    own = functions.filter(F.col("language").isin(*IBMI)).select(F.col("id").alias("fid"), "file_id", "repo_id", F.lower("name").alias("full"), F.lower("simple_name").alias("simple"))
    caller = own.select(F.col("fid").alias("caller_function_id"), F.col("file_id").alias("caller_file"), F.col("repo_id").alias("caller_repo"))
    rows = calls.join(caller, "caller_function_id").select("id", "caller_file", "caller_repo", F.lower("callee_name").alias("key"))
    by_file = unique(own, ["file_id", "full"], "fid", "target").select(F.col("file_id").alias("caller_file"), F.col("full").alias("key"), "target")
    by_repo = unique(own, ["repo_id", "simple"], "fid", "target").select(F.col("repo_id").alias("caller_repo"), F.col("simple").alias("key"), "target")
    by_full = unique(own.filter(dotted(F.col("full"))), ["full"], "fid", "target").withColumnRenamed("full", "key")
    by_simple = unique(own, ["simple"], "fid", "target").withColumnRenamed("simple", "key")
    out = exports.filter("function_id IS NOT NULL").select(F.col("repo_id").alias("x_repo"), F.lower("export_name").alias("key"), F.col("function_id").alias("x"), F.lower("object_name").alias("object"))
    exported = unique(rows.join(out, "key").filter("x_repo <> caller_repo").select("id", "x").distinct(), ["id"], "x", "target")
    refs = bindings.filter("kind = 'ref'").select(F.col("file_id").alias("caller_file"), F.lower("binding_name").alias("binding"))
    entries = bindings.filter("kind = 'entry'").select(F.lower("binding_name").alias("binding"), F.col("repo_id").alias("x_repo"), F.lower("target_object").alias("wanted"))
    bound = rows.join(refs, "caller_file").join(entries, "binding").filter("x_repo <> caller_repo").join(out, ["x_repo", "key"])
    bound = bound.filter(F.col("wanted").isNull() | F.col("object").isNull() | (F.col("wanted") == F.col("object")))
    by_binding = unique(bound.select("id", "x").distinct(), ["id"], "x", "target")
    tiers = [
        (rows.join(by_file, ["caller_file", "key"]), "ibmi_same_file", "high"),
        (rows.join(by_repo, ["caller_repo", "key"]), "ibmi_unique_repo", "medium"),
        (rows.join(by_full, "key"), "qualified_global", "high"),
        (rows.join(by_simple, "key"), "unique_global", "medium"),
        (exported, "ibmi_export", "high"),
        (by_binding, "ibmi_binding", "high"),
    ]
    every = None
    for k, (one, source, confidence) in enumerate(tiers):
        held = one.select("id", "target", F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(k).alias("tier"))
        every = held if every is None else every.unionByName(held)
    return first_of(every, ["id"], "tier").drop("tier")


def parse_time_callee(calls: DataFrame, functions: DataFrame, receivers: DataFrame) -> DataFrame:
    """Targets that a file alone tells: Type.method by the receiver's type there, this or super by the caller's class, else a name unique in
    the file; overloads stay open. receivers: (file_id, receiver, type)."""
    own = functions.select("file_id", F.col("name").alias("key"), F.col("id").alias("target"))
    named = unique(own, ["file_id", "key"], "target", "target")
    simple = unique(functions.select("file_id", F.col("simple_name").alias("key"), F.col("id").alias("t")), ["file_id", "key"], "t", "target")
    caller = functions.select(F.col("id").alias("caller_function_id"), "file_id", class_of(F.col("name")).alias("cls"))
    rows = calls.join(caller, "caller_function_id").withColumn("receiver", F.regexp_extract("callee_name", r"^(.*)\.[^.]+$", 1)).withColumn("method", F.substring_index("callee_name", ".", -1))
    rows = rows.join(receivers, ["file_id", "receiver"], "left")
    own_class = F.when(F.col("receiver").isin("this", "super"), F.col("cls")).otherwise(F.col("type"))
    rows = rows.withColumn("k1", F.concat(own_class, F.lit("."), "method")).withColumn("k2", F.when(F.col("receiver") == "", F.col("method")))
    a = named.select("file_id", F.col("key").alias("k1"), F.col("target").alias("t1"))
    b = simple.select("file_id", F.col("key").alias("k2"), F.col("target").alias("t2"))
    return rows.join(a, ["file_id", "k1"], "left").join(b, ["file_id", "k2"], "left").select("id", F.coalesce("t1", "t2").alias("target")).filter("target IS NOT NULL")


def upstream_gate(names: DataFrame, functions: DataFrame, generic: Column, most: int) -> DataFrame:
    """Names (repo_id, name) that an upstream search by name may use: three letters, not generic, declared at most so often in the repository."""
    declared = functions.groupBy("repo_id", F.col("simple_name").alias("name")).agg(F.count("*").alias("n"))
    ok = (F.length("name") >= 3) & ~generic & (F.coalesce("n", F.lit(0)) <= most)
    return names.join(declared, ["repo_id", "name"], "left").filter(ok).select("repo_id", "name")
