"""Search: buckets, richness, keyword score, trigram similarity, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import columns as C

#: Least similarity of a trigram hit; rows of a capped bucket.
THRESHOLD, BUCKET_ROWS = 0.3, 500


def richness(functions: DataFrame, calls: DataFrame, edges: DataFrame, producers: DataFrame, http: DataFrame) -> DataFrame:
    """functions with out (calls made), inn (calls received), queue, http and richness = out + inn + 50 queue + 50 http."""

    def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))

    out = functions
    for rows, key, name in ((calls, "caller_function_id", "out"), (edges, "callee_function_id", "inn"), (producers, "caller_function_id", "queue"), (http, "caller_function_id", "http")):
        out = out.join(counted(rows, key, name), "id", "left")
    out = out.fillna(0, ["out", "inn", "queue", "http"])
    return out.withColumn("richness", F.col("out") + F.col("inn") + 50 * F.col("queue") + 50 * F.col("http"))


def ranked(functions: DataFrame, pattern: str, limit: int = 0) -> DataFrame:
    """Functions whose name holds pattern: class prefix first, then richness, name, id. limit 0 is none."""
    first = F.startswith(F.lower("name"), F.lit(pattern.lower() + "."))
    found = functions.filter(C.contains_text(F.col("name"), pattern)).orderBy(first.desc(), F.col("richness").desc(), "name", "id")
    return found.limit(limit) if limit else found


def keyword_score(query: str, name: Column, repo: Column, path: Column, source: Column, rich: Column, fan_in: Column, callee_hit: Column, handler: Column) -> Column:
    """Additive relevance of a function to a query; the weights are those users of such a search know."""
    query = query.lower()
    low, low_path, low_repo, low_source = F.lower(name), F.lower(path), F.lower(repo), F.lower(F.coalesce(source, F.lit("")))
    tail = C.leaf(low)
    one = lambda condition, points: F.when(condition, F.lit(points)).otherwise(F.lit(0))
    has = lambda column, text: F.contains(column, F.lit(text))
    points = one(has(low, query), 60) if query else F.lit(0)
    terms = query.split()
    exact = C.any_of(tail == t for t in terms)
    prefix = C.any_of((tail != t) & F.startswith(tail, F.lit(t)) for t in terms)
    if len(terms) > 1:
        in_name = [has(low, t) for t in terms]
        in_repo = [~has(low, t) & has(low_repo, t) for t in terms]
        in_source = [~has(low, t) & ~has(low_repo, t) & has(low_source, t) for t in terms]
        total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
        n, r, s = total(in_name), total(in_repo), total(in_source)
        all_there = n + r + s >= len(terms)
        points = points + 30 * n + 10 * r + 8 * s + F.when(n >= len(terms), 50).when(all_there, 15).otherwise(0)
        points = points + one(exact & all_there, 55) - one(prefix & ~exact, 30) + one((n > 0) & (s > 0), 28) + one((n > 0) & (r > 0), 10) + one(callee_hit, 40)
    elif terms:
        words = F.array_distinct(C.identifier_tokens(F.lit(query)))
        points = points + one(F.arrays_overlap(C.identifier_tokens(name), words), 35) + one(exact, 55)
    if terms:
        points = points + one(C.any_of(F.startswith(low, F.lit(t + ".")) | has(low, "." + t) for t in terms), 15)
    points = points + F.floor(F.least(rich, F.lit(200)) / 8)
    points = points + one(has(low, "controller."), 25) + one(has(low, "service."), 20) + one(has(low, "job") | has(low, "consumer"), 12) + one(has(low_path, "/src/main/java/"), 8) + one(handler, 150)
    points = points - one(C.accessor(name), 30) - one(has(low_path, "/src/test/") | has(low_path, "/test/"), 35) - one(C.frontend_asset(path), 25) - one(C.synthetic_callback(name), 80)
    points = points - one(has(low, "daoimpl.") | has(low, "dao.") | F.endswith(low, F.lit("daoimpl")), 25) - one(low.rlike(r"(filter|mapper|converter|interceptor)\."), 15)
    dot = has(low, ".")
    points = points - one(dot & tail.rlike("^(get|retrieve).*dto|^(get|retrieve)dto"), 15) - one(has(low, "httpclient."), 20) - one(dot & tail.isin("get", "post", "put", "delete"), 20)
    return (points + F.least(F.coalesce(fan_in, F.lit(0)), F.lit(25))).cast("long")


def keyword_search(query: str, buckets: dict[str, DataFrame], facts: DataFrame, limit: int = 0, offset: int = 0, rows: int = BUCKET_ROWS) -> DataFrame:
    """Functions that any bucket finds for any term of a query, best first: (id, name, hits, bucket, score, ...).

    buckets: name -> (id, text), in order; each gives the first rows functions by id whose text holds a term. A function that several buckets or terms
    find stands once, with its first bucket and the number of terms. Noise is left out. Most terms come first, then score, name, id.
    facts: identified functions with name, repo_name, file_path, source, richness, fan_in, callee_hit, handler.
    """
    found = None
    for term in C.search_terms(query):
        for k, (name, texts) in enumerate(buckets.items()):
            held = texts.filter(C.contains_text(F.col("text"), term)).select("id").distinct().orderBy("id").limit(rows)
            held = held.select("id", F.lit(term).alias("term"), F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("bucket"))
            found = held if found is None else found.unionByName(held)
    if found is None:
        found = facts.limit(0).select("id", F.lit("").alias("term"), F.struct(F.lit(0).alias("k"), F.lit("").alias("name")).alias("bucket"))
    once = found.groupBy("id").agg(F.countDistinct("term").alias("hits"), F.min("bucket")["name"].alias("bucket"))
    named = facts.join(once, "id").filter(~C.noise_function(F.col("name"), F.col("repo_name"), F.col("file_path"), F.lit(None).cast("string")))
    score = keyword_score(" ".join(C.search_terms(query)), F.col("name"), F.col("repo_name"), F.col("file_path"), F.col("source"), F.col("richness"), F.col("fan_in"), F.col("callee_hit"), F.col("handler"))
    ordered = named.withColumn("score", score).orderBy(F.col("hits").desc(), F.col("score").desc(), "name", "id").offset(offset)
    return ordered.limit(limit) if limit else ordered


def symbols(kinds: dict[str, DataFrame], pattern: str, limit: int = 0) -> DataFrame:
    """Symbols (kind, name, n) whose name holds pattern, one branch for each kind (name), the first limit of each by name."""
    out = None
    for kind, rows in kinds.items():
        one = rows.filter(C.contains_text(F.col("name"), pattern)).groupBy("name").agg(F.count("*").alias("n")).orderBy("name")
        one = (one.limit(limit) if limit else one).select(F.lit(kind).alias("kind"), "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


def trigram_search(rows: DataFrame, text: str, threshold: float = THRESHOLD, limit: int = 0) -> DataFrame:
    """Rows (kind, id, value) similar to text, best first. Only rows that share a trigram are scored, as any similar row must."""
    wanted = C.trigrams(F.lit(text))
    own = rows.withColumn("__t", C.trigrams(F.col("value"))).filter(F.arrays_overlap("__t", wanted))
    scored = own.withColumn("score", F.round(C.similarity(F.col("__t"), wanted), 6)).drop("__t").filter(F.col("score") >= threshold)
    found = scored.orderBy(F.col("score").desc(), "kind", "id")
    return found.limit(limit) if limit else found


def term_boost(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows (position, name, repo, ...) by how many terms name or repository hold; equal ones keep their order."""
    hits = sum(((C.contains_text(F.col("name"), t) | C.contains_text(F.col("repo"), t)).cast("int") for t in terms), F.lit(0))
    return rows.withColumn("hits", hits).orderBy(F.col("hits").desc(), "position")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page by a full order, with the exact total and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit) if limit else rows.orderBy(*order).offset(offset)
    return cut.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + (limit or 1 << 60))


def clipped(rows: DataFrame, order: list, limit: int) -> tuple[DataFrame, bool]:
    """At most limit rows, and whether there were more, from one read of limit + 1."""
    more = rows.orderBy(*order).limit(limit + 1)
    return more.limit(limit), more.count() > limit


def best_of_each(branches: list[DataFrame], order: list, limit: int) -> DataFrame:
    """A limit for each branch, then their union."""
    out = None
    for one in branches:
        cut = one.orderBy(*order).limit(limit)
        out = cut if out is None else out.unionByName(cut)
    return out


def tags(functions: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """For each function its architecture tags, sorted. sources: tag -> rows (id)."""
    rows = None
    for tag, one in sources.items():
        held = one.select("id").distinct().withColumn("tag", F.lit(tag))
        rows = held if rows is None else rows.unionByName(held)
    return functions.select("id").join(rows, "id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def ranked_window(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)
