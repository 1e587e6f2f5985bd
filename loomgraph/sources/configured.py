"""Facts by an estate's own conventions, which settings name: HTTP wrappers, queue wrappers, resolver registrations, queue handlers by annotation.

Nothing is found without settings. Names match as written, JavaScript methods without regard to case. A fact's owner is the function declared last before
its line.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.sources.code import C_COMMENTS, FACTS, Fact, endings, fact, masked

#: Sections of the settings, verbs that a wrapper may stand for, languages of wrappers: fixed values.
SECTIONS = ("http_clients", "java_sqs", "javascript_queues", "graphql_registrations")
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "CONNECT", "TRACE", "REQUEST", "ANY")
LANGUAGES = ("java", "javascript")
#: Parser languages whose texts are read as JavaScript.
SCRIPTS = ("javascript", "typescript", "vue")


def literal(name: str = "literal") -> str:
    """A pattern of a quoted text, which it names."""
    return rf"""(?P<{name}_quote>['"`])(?P<{name}>[^'"`]+)(?P={name}_quote)"""


def checked(settings: dict[str, Any]) -> dict[str, Any]:
    """settings, or an error where a section, a wrapper's language or a verb is unknown."""
    if odd := sorted(set(settings) - set(SECTIONS)):
        raise ValueError(f"unknown sections {odd}")
    for client in settings.get("http_clients", []):
        if client.get("language") not in LANGUAGES:
            raise ValueError(f"a client's language is {client.get('language')}; it must be one of {LANGUAGES}")
        if odd := sorted(set(client.get("methods", {}).values()) - set(VERBS)):
            raise ValueError(f"unknown verbs {odd}")
    return settings


def script_clients(text: str, clients: list[dict[str, Any]]) -> Iterator[Fact]:
    """Calls object.method(path) and, for a method without a name, object(path)."""
    for client in clients:
        for name in client.get("objects", []):
            for m in re.finditer(rf"(?<![\w.$]){re.escape(name)}(?:\.(?P<method>\w+))?\(\s*{literal()}", text):
                if verb := client.get("methods", {}).get((m["method"] or "").lower()):
                    yield fact("http_call", text, m.start(), verb, target=re.sub(r"\$\{([^}]*)\}", lambda x: ":" + x[1].split(".")[-1], m["literal"]), value=client.get("name", ""))


def java_clients(text: str, clients: list[dict[str, Any]]) -> Iterator[Fact]:
    """Calls whose receiver holds one of a client's texts; a method that clients give different verbs is none."""
    for m in re.finditer(r'(?<![\w.])((?:\w+\.)+)(\w+)\(\s*"([^"\n]+)"', text):
        met = [c for c in clients if m[2] in c.get("methods", {}) and any(x in m[1] for x in c.get("contains", []))]
        if len({c["methods"][m[2]] for c in met}) == 1:
            yield fact("http_call", text, m.start(), met[0]["methods"][m[2]], target=m[3], value=met[0].get("name", ""))


def script_queues(text: str, settings: dict[str, Any]) -> Iterator[Fact]:
    """Sends, reads and deletions on what a receiver loaded: on the load itself, on the receiver after it, or on the variable that it was assigned to."""
    kinds = {m: kind for kind, key in (("queue_producer", "send_methods"), ("queue_consumer", "read_methods"), ("queue_delete", "delete_methods")) for m in settings.get(key, [])}
    if not kinds:
        return
    shape = "|".join(map(re.escape, sorted(kinds, key=len, reverse=True)))
    for receiver in settings.get("load_receivers", []):
        load = rf"(?:(?P<held>[\w$]+)\s*=\s*(?:await\s+)?)?(?<![\w.$]){re.escape(receiver)}\.load\(\s*{literal()}\s*\)"
        loaded: dict[str, str] = {}
        for m in re.finditer(rf"{load}(?:\.(?P<chained>{shape})\()?|(?<![\w.$])(?P<on>{re.escape(receiver)}|[\w$]+)\.(?P<method>{shape})\(", text):
            if m["literal"]:
                loaded[receiver] = m["literal"]
                if m["held"]:
                    loaded[m["held"]] = m["literal"]
                if m["chained"]:
                    yield fact(kinds[m["chained"]], text, m.start("chained"), m["literal"])
            elif m["on"] in loaded:
                yield fact(kinds[m["method"]], text, m.start(), loaded[m["on"]])


def registrations(text: str, known: list[dict[str, Any]]) -> Iterator[Fact]:
    """Folders of resolvers that receiver.method registers: under a key, as a text or as the last part of a joined path."""
    path = rf"(?:path\.(?:join|resolve)\([^()]*?{literal()}\s*\)|{literal('plain')})"
    for one in known:
        key = one.get("controllers_path_key")
        before = rf"\{{[^{{}}]*?\b{re.escape(key)}\s*:\s*" if key else r"\s*"
        for m in re.finditer(rf"(?<![\w.$]){re.escape(one['receiver'])}\.{re.escape(one['method'])}\({before}{path}", text):
            yield fact("graphql_controllers", text, m.start(), one["receiver"], target=m["literal"] or m["plain"])


def java_handlers(text: str, settings: dict[str, Any]) -> Iterator[Fact]:
    """Handler methods of classes that are of a consumer type and carry the annotation: consumers of the constant that it names."""
    annotation, handler = settings.get("queue_annotation"), settings.get("handler_method")
    if not annotation or not handler:
        return
    for m in re.finditer(r"\bclass\s+(\w+)(?:\s*<[^{>]*>)?\s*((?:extends|implements)\b[^{]*)\{", text):
        bases = {x.split(".")[-1] for x in re.findall(r"[\w.]+", re.sub(r"<[^{]*?>", "", m[2]))}
        named = re.search(rf"@{re.escape(annotation)}\(\s*(?:[\w.]+\.)?{re.escape(settings.get('queue_enum', ''))}\.(\w+)\s*\)", text)
        method = re.compile(rf"\b{re.escape(handler)}\s*\([^()]*\)[^;{{]*\{{").search(text, m.end())
        if named and method and bases & set(settings.get("consumer_types", [])):
            yield fact("queue_consumer", text, method.start(), named[1].removesuffix(settings.get("constant_suffix") or "\0"), target=f"{m[1]}.{handler}")


def found(language: str, text: str, settings: dict[str, Any]) -> list[Fact]:
    """Facts of one text by settings, in order of lines."""
    bare = masked(text, C_COMMENTS)
    clients = settings.get("http_clients", [])
    if language in SCRIPTS:
        out = [*script_clients(bare, [c for c in clients if c["language"] == "javascript"]), *script_queues(bare, settings.get("javascript_queues", {})), *registrations(bare, settings.get("graphql_registrations", []))]
    elif language == "java":
        out = [*java_clients(bare, [c for c in clients if c["language"] == "java"]), *java_handlers(bare, settings.get("java_sqs", {}))]
    else:
        out = []
    return sorted(out, key=lambda f: f[5])


def parse_configured(files: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """Facts of files (repo, path, text) by settings, to stand beside those of code.parse_files; a null text gives none. Settings are small and go with the tasks."""
    held = checked(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in FACTS.split(", ")]
        types = [pa.string()] * 8 + [pa.int32()]
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser = endings(path) if text and path else None
                facts = found(parser[0], text, held) if parser else []
                if facts:
                    own = sorted((f[5], f[1]) for f in parser[1](text) if f[0] == "function")
                    for kind, name, _, target, value, line in facts:
                        at = bisect.bisect_right(own, (line, "\U0010ffff")) - 1
                        rows.append((repo, path, parser[0], kind, name, own[at][1] if at >= 0 else "", target, value, line))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("repo", "path", "text").mapInArrow(run, FACTS)
