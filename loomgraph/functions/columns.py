"""Scalar column functions of the engine: identities, routes, queues, names and scores, all in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP methods that a client call can name: fixed values.
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
#: Route segments too common to tell endpoints apart: fixed values.
COMMON_SEGMENTS = (
    "action admin api controller create data delete endpoint external health index internal items list private proxy public query "
    "report reports resource resources service services status swagger update user users value handler"
).split()
#: Accessor prefixes of generic method names: fixed values.
GENERIC_PREFIXES = "get set is has add remove put clear".split()
#: Method names that read or write an entity, exact and by prefix: fixed values.
WRITE_EXACT = "save saveall insert update delete deletebyid persist merge create upsert remove flush".split()
READ_EXACT = "find findall get load list query select search fetch exists count".split()
READ_PREFIXES = "find get load list query select search fetch exists".split()
WRITE_PREFIXES = "save insert update delete create upsert remove".split()
#: Receivers and global functions of standard libraries: fixed values.
STDLIB_RECEIVERS = (
    "array array.prototype boolean console date document error json math number object promise reflect regexp string string.prototype symbol "
    "window process buffer path fs system system.string system.linq.enumerable enumerable convert datetime guid regex task"
).split()
STDLIB_GLOBALS = "parseint parsefloat isnan isfinite encodeuri encodeuricomponent decodeuri decodeuricomponent settimeout cleartimeout setinterval clearinterval".split()
#: Names that are never worth a search hit: fixed values.
NOISE_NAMES = "hashCode equals toString compareTo clone".split()
#: Words that a keyword query leaves out: fixed values.
STOP_WORDS = (
    "what where how does is which when why who the a an in of to for and or this that it with from by can you me show find tell about work "
    "works are was were been being have has had having do did doing"
).split()



def any_of(conditions) -> Column:
    """Disjunction of conditions; of none, false."""
    out = F.lit(False)
    for one in conditions:
        out = out | one
    return out


# identities


def caller_id(repo: Column, file: Column, name: Column) -> Column:
    return F.concat(repo, F.lit(":"), file, F.lit(":"), name)


def caller_part(identity: Column, n: int) -> Column:
    """Repository (1), file (2) or function (3) of an identity; split at colons, never at dots."""
    return F.split_part(identity, F.lit(":"), F.lit(n))


def leaf(name: Column) -> Column:
    """What follows the last dot, or all where nothing does."""
    tail = F.substring_index(name, ".", -1)
    return F.when(tail == "", name).otherwise(tail)


def receiver(name: Column) -> Column:
    """What precedes the last dot; empty without one."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.lit(""))


def strip_this(name: Column) -> Column:
    return F.regexp_replace(name, r"^this\.", "")


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


# canonical forms


def canonical_path(path: Column) -> Column:
    """Lower case, forward slashes, none doubled or at the ends, no leading snapshot folder."""
    path = F.regexp_replace(F.replace(F.lower(F.trim(path)), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    path = F.regexp_replace(F.regexp_replace(path, "^/+", ""), "/+$", "")
    return F.regexp_replace(path, r"^\.codebase-snapshots/[^/]+/", "")


def canonical_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\s+", " ")


def canonical_endpoint(path: Column) -> Column:
    path = F.regexp_replace(F.concat(F.lit("/"), F.lower(F.trim(path))), "/{2,}", "/")
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))


# routes


def normalize_method(method: Column) -> Column:
    method = F.upper(F.trim(F.coalesce(method, F.lit(""))))
    return F.when(method == "", "REQUEST").otherwise(method)


def _path_of(pattern: Column) -> Column:
    """Each step refers to the one before it once, so that the expression stays small."""
    path = F.regexp_replace(F.trim(pattern), r"^https?://[^/?#]*(?=/)", "")
    path = F.replace(F.regexp_replace(path, r"(?s)[?#].*$", ""), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^(?=[^/])", "/")


def normalize_route(pattern: Column) -> Column:
    """Path of a route or URL: rooted, without query, leading base parameters and trailing slash; empty stays empty."""
    return F.regexp_replace(F.regexp_replace(_path_of(pattern), r"^(?:/[:{][^/]*)+/", "/"), "(?<=.)/$", "")


def normalize_audit_route(pattern: Column) -> Column:
    """The audit's form: lower case, base parameters kept, empty is the root."""
    return F.lower(F.regexp_replace(F.regexp_replace(_path_of(pattern), "(?<=.)/+$", ""), "^$", "/"))


def _rooted(path: Column) -> Column:
    return F.regexp_replace(path, "^(?!/)", "/")


def colon_params(path: Column) -> Column:
    return F.regexp_replace(path, r"\{([^/{}]+)\}", ":$1")


def brace_params(path: Column) -> Column:
    return F.regexp_replace(path, r":([A-Za-z0-9_]+)", "{$1}")


def route_variants(path: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """A normalized route, its forms without or with each context prefix, and their parameter styles, in order."""
    forms = [path]
    for prefix in prefixes:
        low = prefix.lower()
        inside = F.startswith(F.lower(path), F.lit(low.rstrip("/") + "/")) | (F.lower(path) == low)
        rest = _rooted(F.substring(path, len(prefix) + 1, 1_000_000))
        forms.append(F.when(inside, rest).otherwise(F.concat(F.lit(prefix.rstrip("/")), path)))
    return F.array_distinct(F.flatten(F.array(*(F.array(x, colon_params(x), brace_params(x)) for x in forms))))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: F.trim(x) != "")


def is_param(segment: Column) -> Column:
    return F.startswith(segment, F.lit(":")) | (F.startswith(segment, F.lit("{")) & F.endswith(segment, F.lit("}")))


def meaningful_segments(path: Column) -> Column:
    """Segments that tell an endpoint: literal, over four letters once - and _ go, not common; distinct, in order."""
    literal = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "*") & ~F.startswith(x, F.lit(":")) & ~F.startswith(x, F.lit("{")))
    folded = F.transform(literal, lambda x: F.regexp_replace(F.lower(x), "[-_]", ""))
    return F.array_distinct(F.filter(folded, lambda x: (F.length(x) > 4) & ~x.isin(*COMMON_SEGMENTS)))


def equal_length_match(left: Column, right: Column) -> Column:
    """Segments agree one by one, a parameter on either side matching anything; none at all is no match."""
    same = F.forall(F.zip_with(left, right, lambda a, b: (a == b) | is_param(a) | is_param(b)), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(left) == F.size(right)) & (F.size(left) > 0) & same


def trailing_match(left: Column, right: Column) -> Column:
    """The audit's rule: agree over the shorter, and only parameters follow in the longer."""
    n = F.least(F.size(left), F.size(right))
    head = F.forall(F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n), lambda a, b: (a == b) | is_param(a) | is_param(b)), lambda x: x)
    tail = lambda xs: F.forall(F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0))), is_param)
    return (n > 0) & head & tail(left) & tail(right)


def flow_match(call: Column, endpoint: Column) -> Column:
    """One-sided: equal length, parameters on the call's side alone, a literal segment in the call."""
    same = F.forall(F.zip_with(call, endpoint, lambda a, b: (a == b) | is_param(a)), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(call) == F.size(endpoint)) & same & F.exists(call, lambda x: ~is_param(x))


def route_like(method: Column, client_type: Column, path: Column) -> Column:
    """Whether a call's audit route can be an endpoint's."""
    one = r"(?:[a-z0-9._-]+|:[a-z0-9._-]+|\{[a-z0-9._-]+\})"
    wide = method.isin("REQUEST", "ANY")
    return (
        (F.lower(F.trim(F.coalesce(client_type, F.lit("")))) != "navigation")
        & (path != "/")
        & path.rlike(f"^/{one}(?:/{one})*$")
        & ~(wide & (path.rlike("^/api[^/]*$") | path.rlike("^/:[^/]+$")))
    )


def legacy_route(path: Column) -> Column:
    return F.lower(F.trim(path)).rlike(r"\.(asp|aspx|php|jsp|cfm)(/|$)")


# queues


def normalize_queue(name: Column) -> Column:
    """Queue name without percent marks, ARN and URL parts."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "^%+", ""), "%+$", ""))
    name = F.regexp_replace(name, "^arn:(?:.*:)?(?=[^:]+$)", "")
    name = F.regexp_replace(name, r"(?s)^(https?://[^/?#]+/[^?#]*)[?#].*$", "$1")
    return F.trim(F.substring_index(name, "/", -1))


def queue_variants(name: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Sorted lower-case names under which a queue may be consumed."""
    base = normalize_queue(name)
    bare = F.when(F.length(base) > 5, F.regexp_replace(base, r"(?i)\.fifo$", "")).otherwise(base)
    out = [name, base, F.when(base.rlike("^[A-Z0-9_]*_[A-Z0-9_]*$"), F.concat(F.lit("%"), base, F.lit("%"))), bare]
    for prefix in prefixes:
        for x in (base, bare):
            out.append(F.when(F.startswith(F.lower(x), F.lit(prefix)) & (F.length(x) > len(prefix)), F.substring(x, len(prefix) + 1, 1_000_000)))
    folded = F.transform(F.array(*out), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(folded, lambda x: x.isNotNull() & (x != ""))))


def audit_queue(name: Column, strip_fifo: bool = False) -> Column:
    """The audit's queue form. Its suffix pattern asks for a literal backslash unless strip_fifo is set."""
    name = F.regexp_replace(name, "^arn:[^:]+:sqs:[^:]+:[^:]+:", "")
    name = F.regexp_replace(F.regexp_replace(name, "^https?://[^/]+/[^/]+/", ""), "^.*/", "")
    return F.lower(F.regexp_replace(name, r"\.fifo$" if strip_fifo else r"\\.fifo$", ""))


def alias_queue(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), "^%+", ""), "%+$", ""))


# text and search


def escape_like(text: str) -> str:
    """User text as a LIKE pattern in which nothing is a wildcard."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def contains_text(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def repo_filter(column: Column, wanted: str) -> Column:
    """A trailing * is a prefix, else equality; case aside."""
    low = wanted.strip().lower()
    return F.startswith(F.lower(column), F.lit(low[:-1])) if low.endswith("*") else F.lower(column) == low


def function_named(column: Column, name: str) -> Column:
    """The whole name, or its last part; case aside."""
    low = name.lower()
    return (F.lower(column) == low) | F.endswith(F.lower(column), F.lit("." + low))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of lower-case alphanumeric words, padded by two spaces before and one after."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(found, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(0.0))


def identifier_tokens(name: Column) -> Column:
    """Lower-case words of an identifier: split at separators and where a capital follows a small letter or digit."""
    split = F.regexp_replace(name, r"[._\-/\\:()\[\]{},;\s]+", " ")
    split = F.regexp_replace(split, r"([\p{Ll}\p{Nd}])(?=\p{Lu})", "$1 ")
    return F.filter(F.split(F.lower(split), r"\s+"), lambda x: x != "")


def search_terms(query: str) -> list[str]:
    """Terms of a keyword query: a dotted or single word stays whole, stop words and repeats go."""
    query = query.strip()
    found = query.lower().split()
    if not query:
        return []
    if "." in query or len(found) <= 1:
        return [query]
    kept = dict.fromkeys(w for w in (x.strip("?.,!\"'") for x in found) if len(w) >= 2 and w not in STOP_WORDS)
    return list(kept) or [query]


def accessor(name: Column) -> Column:
    return leaf(name).rlike("^(get|set|is|has)[A-Z]")


def significant_lines(source: Column) -> Column:
    """Lines that aren't blank, a lone brace, a comment or an annotation."""
    return F.size(F.filter(F.split(source, "\n"), lambda x: ~F.trim(x).rlike(r"^(?:[{}]?|//.*|/\*.*|\*.*|@.*)$")))


def synthetic_callback(name: Column) -> Column:
    low = F.lower(name)
    return F.contains(low, F.lit("jquery.")) | F.contains(low, F.lit(".jquery")) | F.contains(low, F.lit("anonymous")) | low.rlike("_l[0-9]+$")


def frontend_asset(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"\.(js|jsx|ts|tsx)$") | F.contains(low, F.lit("/src/main/webapp/"))


def noise_function(name: Column, repo: Column, path: Column, source: Column) -> Column:
    """Functions that a search leaves out: test repositories, boilerplate, short accessors, generated code, callbacks."""
    low = F.lower(path)
    short = accessor(name) & (F.coalesce(source, F.lit("")) != "") & (significant_lines(source) <= 3)
    generated = F.contains(low, F.lit("/generated/")) | F.contains(low, F.lit("/target/generated-sources/")) | F.contains(low, F.lit("objectfactory"))
    query = frontend_asset(path) & F.contains(F.lower(name), F.lit("jquery."))
    flags = F.lower(repo).rlike("-tests?$") | leaf(name).isin(*NOISE_NAMES) | short | generated | synthetic_callback(name) | query
    return F.coalesce(flags, F.lit(False))


def generic_method(name: Column) -> Column:
    """Accessor-shaped names of under fifteen letters; after a bare prefix must come a boundary."""
    prefixes = "|".join(GENERIC_PREFIXES)
    dotted = F.lower(name).rlike(f"^(?:{prefixes})")
    bare = name.rlike(f"^(?i:{prefixes})(?:$|[_A-Z0-9])")
    return (F.length(name) < 15) & F.when(F.contains(name, F.lit(".")), dotted).otherwise(bare)


def test_path(path: Column) -> Column:
    """Test sources by folder or by file name."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return (
        low.rlike(r"(^|/)(test|tests|__tests__|testing|testdata)/")
        | low.rlike(r"\.(test|spec)\.(js|jsx|ts|tsx|mjs|cjs)$")
        | low.rlike(r"(^|/)[^/]*_test\.go$")
        | base.rlike(r"(Test|Tests|TestCase)\.(java|kt|cs)$")
        | base.rlike(r"(^|[a-z0-9])(IT|ITCase)\.java$")
        | base.rlike(r"^Test[A-Z0-9][^/]*\.java$")
    )


def access_class(method: Column) -> Column:
    """write, read or empty by a method's name: exact names, then read prefixes, then write prefixes."""
    low = F.lower(method)
    return (
        F.when(low.isin(*WRITE_EXACT), "write")
        .when(low.isin(*READ_EXACT), "read")
        .when(low.rlike("^(" + "|".join(READ_PREFIXES) + ")"), "read")
        .when(low.rlike("^(" + "|".join(WRITE_PREFIXES) + ")"), "write")
        .otherwise("")
    )


def unresolved_reason(callee: Column) -> Column:
    """Why a call has no target: stdlib_csharp, stdlib_js, framework, dynamic_receiver or unknown; empty callees give none."""
    own, method, low = receiver(callee), F.lower(leaf(callee)), F.lower(callee)
    held = F.lower(F.trim(own))
    std = ((held == "") & method.isin(*STDLIB_GLOBALS)) | held.isin(*STDLIB_RECEIVERS) | low.rlike(r"^(system|microsoft|string|datetime|guid|console)\.")
    sharp = low.rlike(r"^(system|microsoft|string|datetime|guid)\.") | held.isin("system", "enumerable") | F.startswith(held, F.lit("system."))
    frame = (
        (held == "$")
        | held.rlike(r"^(\$\.|jquery|this\.\$)")
        | F.startswith(low, F.lit("this.$"))
        | F.contains(held, F.lit("axios"))
        | F.contains(low, F.lit("axios."))
        | held.isin("vue", "vuex", "pinia", "router", "route")
        | (F.startswith(method, F.lit("use")) & low.rlike("route|store"))
    )
    dynamic = (own != "") & (own.rlike(r"[()\[\].{}]") | F.contains(own, F.lit("=>")) | own.rlike(r"^\s*new "))
    return F.when(F.trim(callee) == "", "").when(std & sharp, "stdlib_csharp").when(std, "stdlib_js").when(frame, "framework").when(dynamic, "dynamic_receiver").otherwise("unknown")


# types and entities


def erase_generics(name: Column) -> Column:
    """A type without its arguments, the innermost brackets first, in as many rounds as brackets open: nothing is left to remove then."""
    opened = F.length(name) - F.length(F.replace(name, F.lit("<")))
    rounds = F.when(opened > 0, F.sequence(F.lit(1), opened)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, name, lambda held, _: F.regexp_replace(held, "<[^<>]*>", ""))


def normalize_type(name: Column) -> Column:
    """A type's simple name: no arguments, arrays or package."""
    bare = F.trim(F.regexp_replace(erase_generics(name), r"(\[\])+$", ""))
    return F.substring_index(bare, ".", -1)


def entity_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9]", ""))


# scores


def impact_score(depth: Column, fanout: Column) -> Column:
    return (1 / (depth + 1)) * (1 + F.log1p(fanout))


def freshness(age_hours: Column) -> Column:
    return F.when(age_hours <= 24, "recent").when(age_hours <= 24 * 7, "aging").otherwise("stale")


def lower_confidence(confidence: Column) -> Column:
    return F.when(confidence == "high", "medium").otherwise("low")


def glob_regex(pattern: str) -> str:
    """An ownership glob as a regular expression over paths without a leading slash.

    A slash before the last character, or at the start, anchors the pattern at the root; * and ? stay within a segment, ** passes them; a
    pattern that ends in a slash owns what lies under that folder, any other the path and what lies under it.
    """
    rooted = "/" in pattern.rstrip("/")
    folder, body = pattern.endswith("/"), pattern.strip("/")
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    tail = "/.*" if folder else "$" if body.endswith("/*") else "(?:/.*)?"
    return ("^" if rooted else "^(?:.*/)?") + out + tail + ("" if tail == "$" else "$")
