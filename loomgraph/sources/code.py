"""Source files to facts. A registry maps file endings to parsers; each takes a text and gives facts, run file by file on executors.

The parsers read declarations, calls and boundary facts by pattern; they make no syntax trees. A fact is (kind, name, owner, target, value, line):
owner is the enclosing function or class, target what is called, accessed, extended or routed to.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fact = tuple[str, str, str, str, str, int]
FACTS = "repo string, path string, language string, kind string, name string, owner string, target string, value string, line int"
PARSERS: dict[str, tuple[str, Callable[[str], list[Fact]]]] = {}
#: Folders that hold no sources of their own: fixed values.
VENDORED = "node_modules vendor bower_components .git .svn dist target build bin obj __pycache__ .venv".split()


def parser(language: str, *endings: str):
    """Register a parser for file endings; a later one for the same ending replaces it."""

    def put(f):
        for e in endings:
            PARSERS[e] = (language, f)
        return f

    return put


@functools.lru_cache(maxsize=2)
def line_starts(text: str) -> list[int]:
    return [m.end() for m in re.finditer("\n", text)]


def line_of(text: str, at: int) -> int:
    """Line of a place; the line breaks of a text are found once."""
    return bisect.bisect_right(line_starts(text), at) + 1


def masked(text: str, comments: str, strings: bool = False) -> str:
    """The text with comments, and strings if asked, blanked out; places stay."""
    pattern = re.compile(comments + (r"""|'(?:''|\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*\"""" if strings else ""), re.S | re.M)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


C_COMMENTS = r"/\*.*?\*/|(?<![:'\"])//[^\n]*"


def block_end(text: str, at: int, open_: str = "{", close: str = "}") -> int:
    """Place after the block that opens at or after a place; the end of the text if it never closes."""
    start = text.find(open_, at)
    depth = 0
    if start < 0:
        return len(text)
    for m in re.compile(f"[{re.escape(open_)}{re.escape(close)}]").finditer(text, start):
        depth += 1 if m[0] == open_ else -1
        if not depth:
            return m.end()
    return len(text)


def owner_at(spans: list[tuple[int, int, str]], at: int) -> str:
    """The innermost span's name around a place."""
    held = [(b - a, name) for a, b, name in spans if a <= at < b]
    return min(held)[1] if held else ""


def fact(kind: str, text: str, at: int, name: str = "", owner: str = "", target: str = "", value: str = "") -> Fact:
    return (kind, name, owner, target, value, line_of(text, at))


def calls(text: str, spans: list[tuple[int, int, str]], declared: set[int], skip: str) -> list[Fact]:
    """Calls inside functions, each with its dotted name."""
    out = []
    for m in re.finditer(r"(?<![\w.$@])((?:this\.)?[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(", text):
        own = owner_at(spans, m.start())
        if own and m.start(1) not in declared and not re.fullmatch(skip, m[1]):
            out.append(fact("call", text, m.start(), m[1], own, m[1]))
    return out


KEYWORDS = "if|for|while|switch|catch|return|function|new|super|synchronized|using|lock|foreach|sizeof|typeof|await|nameof|throw|else|do|try|func|select|go|defer|range|case|constructor|async"


@parser("javascript", ".js", ".jsx", ".mjs", ".cjs")
@parser("typescript", ".ts", ".tsx")
def javascript(source: str) -> list[Fact]:
    text = masked(source, C_COMMENTS)
    out, spans, declared = [], [], set()
    classes = [(m.start(), block_end(text, m.end()), m[1]) for m in re.finditer(r"\bclass\s+(\w+)", text)]
    for m in re.finditer(r"\bclass\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w.,\s]+?))?\s*\{", text):
        out.append(fact("class", text, m.start(), m[1]))
        out += [fact("extends", text, m.start(), m[1], target=m[2])] if m[2] else []
        out += [fact("implements", text, m.start(), m[1], target=x.strip()) for x in (m[3] or "").split(",") if x.strip()]
    out += [fact("interface", text, m.start(), m[1]) for m in re.finditer(r"\binterface\s+(\w+)", text)]
    out += [fact("type_alias", text, m.start(), m[1]) for m in re.finditer(r"^\s*(?:export\s+)?type\s+(\w+)[^=\n]*=", text, re.M)]
    shapes = (
        r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\(",
        r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>",
        r"^\s*(?:(?:public|private|protected|static|async|get|set)\s+)*([A-Za-z_$][\w$]*)\s*\([^()\n]*\)\s*(?::\s*[^{;\n]+)?\{",
    )
    for k, shape in enumerate(shapes):
        for m in re.finditer(shape, text, re.M):
            own = owner_at(classes, m.start())
            if re.fullmatch(KEYWORDS, m[1]) or (k == 2 and not own):
                continue
            name = f"{own}.{m[1]}" if own and k == 2 else m[1]
            spans.append((m.start(), block_end(text, m.end() - (k == 2)), name))
            declared.add(m.start(1))
            out.append(fact("function", text, m.start(1), name, own))
    for m in re.finditer(r"""\b(?:router|app|server|fastify)\.(get|post|put|patch|delete|all)\(\s*(['"`])([^'"`]+)\2\s*,\s*(?:[\w$.]+\s*,\s*)*([\w$.]+)?""", text):
        out.append(fact("endpoint", text, m.start(), "REQUEST" if m[1] == "all" else m[1].upper(), target=m[3], value=m[4] or ""))
    for m in re.finditer(r"""\b(axios|http|client|api|\$http)\.(get|post|put|patch|delete|head)\s*(?:<[^<>()]*>)?\(\s*(['"`])([^'"`]+)\3""", text):
        out.append(fact("http_call", text, m.start(), m[2].upper(), owner_at(spans, m.start()), re.sub(r"\$\{([^}]*)\}", lambda x: ":" + x[1].split(".")[-1], m[4]), m[1]))
    for m in re.finditer(r"""\bfetch\(\s*(['"`])([^'"`]+)\1(?:\s*,\s*\{[^}]*?method\s*:\s*['"](\w+)['"])?""", text):
        out.append(fact("http_call", text, m.start(), (m[3] or "GET").upper(), owner_at(spans, m.start()), re.sub(r"\$\{([^}]*)\}", lambda x: ":" + x[1].split(".")[-1], m[2]), "fetch"))
    for m in re.finditer(r"""\bQueueUrl\s*:\s*(['"`]?)([^'"`,\s})]+)\1""", text):
        out.append(fact("queue_producer", text, m.start(), m[2].removeprefix("process.env."), owner_at(spans, m.start())))
    for m in re.finditer(r"""\bimport\s+(?:(.+?)\s+from\s+)?['"]([^'"]+)['"]""", text):
        out.append(fact("import", text, m.start(), (m[1] or "").strip(), target=m[2]))
    for m in re.finditer(r"(?<![\w.])(use[A-Z]\w*)\s*\(", text):
        out.append(fact("hook", text, m.start(), m[1], owner_at(spans, m.start())))
    return out + calls(text, spans, declared, KEYWORDS)


@parser("vue", ".vue")
def vue(source: str) -> list[Fact]:
    """Facts of each script block, at their lines in the file."""
    out = []
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", source, re.S):
        shift = line_of(source, m.start(1)) - 1
        out += [(*x[:5], x[5] + shift) for x in javascript(m[1])]
    return out


MAPPING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "REQUEST", "HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}


def joined(base: str, path: str) -> str:
    return "/" + "/".join(x.strip("/") for x in (base, path) if x.strip("/"))


def members(text: str, classes: list[tuple[int, int, str]], shape: str) -> tuple[list[tuple[int, int, str]], set[int], list[Fact]]:
    """Methods of classes: their spans, the places of their names, their facts."""
    spans, declared, out = [], set(), []
    for m in re.finditer(shape, text, re.M):
        own = owner_at(classes, m.start())
        if own and not re.fullmatch(KEYWORDS, m["name"]):
            name = f"{own}.{m['name']}"
            spans.append((m.start(), block_end(text, m.end() - 1), name))
            declared.add(m.start("name"))
            out.append(fact("function", text, m.start("name"), name, own, value=re.sub(r"\s+", " ", m["params"]).strip()))
    return spans, declared, out


@parser("java", ".java")
def java(source: str) -> list[Fact]:
    text, plain = masked(source, C_COMMENTS), masked(source, C_COMMENTS, True)  # plain: strings hold no braces
    out, classes, bases = [], [], {}
    for m in re.finditer(r"\b(class|interface|enum|record)\s+(\w+)(?:<[^{]*?>)?(?:\([^)]*\))?(?:\s+extends\s+([\w.<>, ]+?))?(?:\s+implements\s+([\w.<>, ]+?))?\s*\{", text):
        classes.append((m.start(), block_end(plain, m.end() - 1), m[2]))
        out.append(fact("interface" if m[1] == "interface" else "class", text, m.start(), m[2]))
        kind = "extends"
        for group, kind in ((m[3], "extends"), (m[4], "implements")):
            out += [fact(kind, text, m.start(), m[2], target=x.strip()) for x in re.split(r",(?![^<]*>)", group or "") if x.strip()]
        head = text[max(0, plain.rfind("}", 0, m.start()), plain.rfind(";", 0, m.start())) : m.start()]
        if found := re.search(r"""@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?"([^"]*)\"""", head):
            bases[m[2]] = found[1]
        if "@Entity" in head:
            table = re.search(r'@Table\([^)]*name\s*=\s*"([^"]+)"', head)
            out.append(fact("entity", text, m.start(), m[2], target=table[1] if table else m[2]))
    spans, declared, found = members(plain, classes, r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s+)?[\w.<>\[\], ?]+\s+(?P<name>\w+)\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w., ]+)?\s*\{")
    out += found
    for start, _, name in spans:
        head = text[max(plain.rfind("}", 0, start), plain.rfind(";", 0, start), plain.rfind("{", 0, start)) + 1 : start]
        for m in re.finditer(r'@(\w+)(?:\((?:[^()"]*"([^"]*)"[^()]*|[^()]*)\))?', head):
            own = name.rsplit(".", 1)[0]
            if m[1] in MAPPING:
                method = re.search(r"RequestMethod\.(\w+)", m[0])
                out.append(fact("endpoint", text, start, method[1] if method else MAPPING[m[1]], name, joined(bases.get(own, ""), m[2] or ""), name))
            elif m[1] in ("SqsListener", "JmsListener", "KafkaListener", "RabbitListener"):
                out.append(fact("queue_consumer", text, start, m[2] or "", name))
            elif m[1] == "Scheduled":
                out.append(fact("scheduled", text, start, name, name, value=m[2] or ""))
            elif m[1] != "Override":
                out.append(fact("annotation", text, start, m[1], name, value=m[2] or ""))
    for m in re.finditer(r'(@(?:Autowired|Inject|Resource)\s+)?(?:@Qualifier\("([^"]+)"\)\s*)?(?:private|protected|public)\s+(?:final\s+)?([\w.<>]+)\s+(\w+)\s*[;=]', text):
        if own := owner_at(classes, m.start()):
            out.append(fact("field", text, m.start(), m[4], own, m[3], m[2] or ""))
    for m in re.finditer(r'\b(?:restTemplate|webClient|client)\.(get|post|put|delete|patch)\w*\(\s*"([^"]+)"', text):
        out.append(fact("http_call", text, m.start(), m[1].upper(), owner_at(spans, m.start()), m[2], "rest"))
    for m in re.finditer(r'\b(?:sqsTemplate|queueMessagingTemplate|amazonSQS|sqsClient)\.(?:send|convertAndSend|sendMessage)\(\s*"([^"]+)"', text):
        out.append(fact("queue_producer", text, m.start(), m[1], owner_at(spans, m.start())))
    out += [fact("import", text, m.start(), m[1].rsplit(".", 1)[-1], target=m[1]) for m in re.finditer(r"^import\s+(?:static\s+)?([\w.*]+);", text, re.M)]
    return out + calls(text, spans, declared, KEYWORDS)


@parser("csharp", ".cs")
def csharp(source: str) -> list[Fact]:
    text, plain = masked(source, C_COMMENTS), masked(source, C_COMMENTS, True)  # plain: strings hold no braces
    out, classes, bases = [], [], {}
    for m in re.finditer(r"\b(class|interface|record|struct)\s+(\w+)(?:<[^{]*?>)?(?:\([^)]*\))?(?:\s*:\s*([\w.<>, ]+?))?\s*\{", text):
        classes.append((m.start(), block_end(plain, m.end() - 1), m[2]))
        out.append(fact("interface" if m[1] == "interface" else "class", text, m.start(), m[2]))
        for x in re.split(r",(?![^<]*>)", m[3] or ""):
            if x.strip():
                out.append(fact("implements" if re.match(r"\s*I[A-Z]", x) else "extends", text, m.start(), m[2], target=x.strip()))
        head = text[max(0, plain.rfind("}", 0, m.start()), plain.rfind(";", 0, m.start())) : m.start()]
        if found := re.search(r'\[Route\("([^"]*)"\)\]', head):
            bases[m[2]] = found[1].replace("[controller]", m[2].removesuffix("Controller").lower())
    spans, declared, found = members(plain, classes, r"^[ \t]*(?:(?:public|private|protected|internal|static|async|override|virtual|sealed)\s+)+[\w.<>\[\]?, ]+\s+(?P<name>\w+)\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*\{")
    out += found
    for start, end, name in spans:
        head = text[max(plain.rfind("}", 0, start), plain.rfind(";", 0, start), plain.rfind("{", 0, start)) + 1 : start]
        for m in re.finditer(r'\[(Http\w+)(?:\("([^"]*)"\))?\]', head):
            if m[1] in MAPPING:
                out.append(fact("endpoint", text, start, MAPPING[m[1]], name, joined(bases.get(name.rsplit(".", 1)[0], ""), m[2] or ""), name))
        for m in re.finditer(r"\b_?(?:context|db|dbContext)\.(\w+)\.(\w+)\(", text[start:end]):
            access = "write" if re.match("Add|Update|Remove|Attach|Execute(Update|Delete)", m[2]) else "read"
            out.append(fact("data_access", text, start + m.start(), m[1], name, value=access))
    for m in re.finditer(r'\bMap(Get|Post|Put|Delete|Patch)\(\s*"([^"]+)"\s*,\s*([\w.]+)?', text):
        out.append(fact("endpoint", text, m.start(), m[1].upper(), target=m[2], value=m[3] or ""))
    for m in re.finditer(r'\b\w*[cC]lient\.(Get|Post|Put|Delete|Patch)\w*Async(?:<[^()]*>)?\(\s*\$?"([^"]+)"', text):
        out.append(fact("http_call", text, m.start(), m[1].upper(), owner_at(spans, m.start()), re.sub(r"\{([^}]*)\}", lambda x: ":" + x[1].split(".")[-1], m[2]), "http"))
    for m in re.finditer(r'\.Subscribe\(\s*"([^"]+)"', text):
        out.append(fact("queue_consumer", text, m.start(), m[1], owner_at(spans, m.start())))
    return out + calls(text, spans, declared, KEYWORDS)


@parser("go", ".go")
def golang(source: str) -> list[Fact]:
    text = masked(source, C_COMMENTS)
    out, spans, declared = [], [], set()
    for m in re.finditer(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", text, re.M):
        name = f"{m[1]}.{m[2]}" if m[1] else m[2]
        spans.append((m.start(), block_end(text, m.end()), name))
        declared.add(m.start(2))
        out.append(fact("function", text, m.start(), name, m[1] or ""))
    out += [fact("class" if m[2] == "struct" else "interface", text, m.start(), m[1]) for m in re.finditer(r"^type\s+(\w+)\s+(struct|interface)\b", text, re.M)]
    for m in re.finditer(r'\.(?:HandleFunc|Handle)\(\s*"(?:([A-Z]+) )?([^"]+)"\s*,\s*([\w.]+)', text):
        out.append(fact("endpoint", text, m.start(), m[1] or "REQUEST", target=m[2], value=m[3]))
    for m in re.finditer(r'\bhttp\.(Get|Post|Head)\(\s*"([^"]+)"', text):
        out.append(fact("http_call", text, m.start(), m[1].upper(), owner_at(spans, m.start()), m[2], "http"))
    return out + calls(text, spans, declared, KEYWORDS)


NAME = r"[\w$#@]+(?:\.[\w$#@]+)*"
SQL_WORDS = "select|where|set|values|on|as|inner|left|right|full|cross|join|lateral|only|unnest|dual|table"


def table_accesses(text: str) -> list[tuple[str, str, int]]:
    """(table, access, place) of a statement: what it writes, and what it reads; names of its own CTEs aside."""
    clean = re.sub(r'["`\[\]]', " ", masked(text, r"--[^\n]*|/\*.*?\*/", True))
    own = {m[1].lower() for m in re.finditer(rf"(?:\bwith(?:\s+recursive)?|,)\s+({NAME})\s*(?:\([^()]*\)\s*)?as\s*\(", clean, re.I)}
    out, taken = [], set()
    for m in re.finditer(rf"\b(?:insert\s+(?:overwrite\s+)?into|update|delete\s+from|merge\s+into|truncate\s+table)\s+({NAME})", clean, re.I):
        if not re.fullmatch(SQL_WORDS, m[1], re.I):
            out.append((m[1].lower(), "write", m.start()))
            taken.add(m.start(1))
    for m in re.finditer(rf"\b(?:from|join|using)\s+({NAME})(?!\s*\()", clean, re.I):
        if m.start(1) not in taken and not re.fullmatch(SQL_WORDS, m[1], re.I) and m[1].lower() not in own:
            out.append((m[1].lower(), "read", m.start()))
    return out


@parser("sql", ".sql", ".pls", ".pkb")
def sql(source: str) -> list[Fact]:
    text = masked(source, r"--[^\n]*|/\*.*?\*/", True)
    starts = [(m.start(), m[2]) for m in re.finditer(rf"\bcreate\s+(?:or\s+(?:replace|alter)\s+)?(procedure|function|trigger|view)\s+({NAME})", text, re.I)]
    out, spans = [], []
    for k, (at, name) in enumerate(starts):
        spans.append((at, starts[k + 1][0] if k + 1 < len(starts) else len(text), name))
        out.append(fact("function", source, at, name))
    out += [fact("data_access", source, at, table, owner_at(spans, at), value=access) for table, access, at in table_accesses(source)]
    for m in re.finditer(rf"\b(?:call|exec(?:ute)?)\s+({NAME})", text, re.I):
        out.append(fact("call", source, m.start(), m[1], owner_at(spans, m.start()), m[1]))
    return out


@parser("rpgle", ".rpgle", ".sqlrpgle")
def rpg(source: str) -> list[Fact]:
    text = masked(source, r"//[^\n]*|^.{5}[ \w]\*[^\n]*|^\*[^\n]*")
    out, spans, declared = [], [], set()
    for m in re.finditer(r"\bdcl-proc\s+(\w+)", text, re.I):
        end = re.compile(r"\bend-proc\b", re.I).search(text, m.end())
        spans.append((m.start(), end.end() if end else len(text), m[1].lower()))
        declared.add(m.start(1))
        out.append(fact("export" if re.match(r"\s+export", text[m.end() :], re.I) else "function", text, m.start(), m[1].lower()))
    files = {m[1].lower() for m in re.finditer(r"\bdcl-f\s+(\w+)", text, re.I)}
    for m in re.finditer(r"^\s*(chain|setll|read|reade|readp|write|update|delete)\s+(?:\([^)]*\)\s*|\w+\s+)?(\w+)\s*;", text, re.I | re.M):
        access = "write" if m[1].lower() in ("write", "update", "delete") else "read"
        out.append(fact("data_access", text, m.start(), m[2].lower(), owner_at(spans, m.start()), value=access))
    for m in re.finditer(r"\bexec\s+sql\b(.*?);", text, re.I | re.S):
        out += [fact("data_access", text, m.start(1) + at, table, owner_at(spans, m.start()), value=access) for table, access, at in table_accesses(m[1])]
    for m in re.finditer(r"(?:\bcallp\s+)?\b(\w+)\s*\(", text, re.I):
        if m.start(1) not in declared and owner_at(spans, m.start()) and not re.match(r"dcl|%|if|dow|select|exec|in|and|or|not|extpgm|char|varchar|packed|zoned|likeds|values", m[1], re.I):
            out.append(fact("call", text, m.start(1), m[1].lower(), owner_at(spans, m.start()), m[1].lower()))
    out += [fact("file", text, 0, f) for f in sorted(files)]
    out += [fact("import", text, m.start(), m[1].lower(), target=m[1].lower()) for m in re.finditer(r"^\s*/(?:copy|include)\s+(\S+)", text, re.I | re.M)]
    return out


@parser("clle", ".clle", ".clp")
def control_language(source: str) -> list[Fact]:
    text = re.sub(r"[+-]\s*\n\s*", " ", masked(source, r"/\*.*?\*/"))
    out = [fact("program", text, m.start(), "pgm") for m in re.finditer(r"^\s*PGM\b", text, re.I | re.M)]
    out += [fact("call", text, m.start(), m[2].lower(), "pgm", m[2].lower(), (m[1] or "").lower()) for m in re.finditer(r"\bCALL\s+PGM\((?:(\w+|\*\w+)/)?(\w+)\)", text, re.I)]
    return out + [fact("data_access", text, m.start(), m[1].lower(), "pgm", value="read") for m in re.finditer(r"\bDCLF\s+FILE\((?:[\w*]+/)?(\w+)\)", text, re.I)]


@parser("dds", ".dspf", ".pf", ".lf")
def dds(source: str) -> list[Fact]:
    out, record = [], ""
    for k, line in enumerate(source.split("\n"), 1):
        body = line[16:] if len(line) > 16 else ""
        if line[6:7] == "*" or not body.strip():
            continue
        if body[:1] == "R" and body[1:2] == " ":
            record = body[2:12].split()[0] if body[2:12].split() else ""
            out.append(("class", record.lower(), "", "", "", k))
        elif body[:2].strip() == "" and (name := body[2:12].strip()) and re.fullmatch(r"\w+", name):
            out.append(("field", name.lower(), record.lower(), "", body[18:19].strip(), k))
    return out


@parser("binder", ".bnd")
def binder(source: str) -> list[Fact]:
    return [fact("export", source, m.start(), m[1].lower()) for m in re.finditer(r"\bEXPORT\s+SYMBOL\(\s*['\"]?(\w+)['\"]?\s*\)", source, re.I)]


@parser("powershell", ".ps1", ".psm1")
def powershell(source: str) -> list[Fact]:
    text = masked(source, r"<#.*?#>|(?<!`)#[^\n]*")
    out, spans = [], []
    for m in re.finditer(r"\bfunction\s+([\w-]+)", text, re.I):
        spans.append((m.start(), block_end(text, m.end()), m[1]))
        out.append(fact("function", text, m.start(), m[1]))
    for m in re.finditer(r"\bInvoke-(?:RestMethod|WebRequest)\b([^\n|;]*)", text, re.I):
        uri = re.search(r"""-Uri\s+["']?([^"'\s]+)""", m[1], re.I)
        method = re.search(r"-Method\s+(\w+)", m[1], re.I)
        if uri:
            out.append(fact("http_call", text, m.start(), (method[1] if method else "GET").upper(), owner_at(spans, m.start()), uri[1], "powershell"))
    for m in re.finditer(r"^\s*([A-Z][a-z]+-[A-Z]\w+)\b", text, re.M):
        if not m[1].lower().startswith("invoke-"):
            out.append(fact("call", text, m.start(1), m[1], owner_at(spans, m.start()), m[1]))
    return out


@parser("terraform", ".tf")
def terraform(source: str) -> list[Fact]:
    text = masked(source, r"/\*.*?\*/|#[^\n]*|(?<!:)//[^\n]*")
    out = []
    for m in re.finditer(r'\bresource\s+"(\w+)"\s+"(\w+)"\s*\{', text):
        body = text[m.end() : block_end(text, m.end() - 1)]
        value = lambda key: (re.search(rf'\b{key}\s*=\s*"([^"]*)"', body) or [None, ""])[1]  # noqa: E731, B023
        out.append(fact("resource", text, m.start(), value("name") or m[2], target=m[1]))
        if m[1] in ("aws_cloudwatch_event_rule", "aws_scheduler_schedule"):
            out.append(fact("schedule", text, m.start(), value("name") or m[2], value=value("schedule_expression")))
        if m[1] in ("aws_sqs_queue", "azurerm_servicebus_queue"):
            out.append(fact("queue", text, m.start(), value("name") or m[2]))
    return out


@parser("graphql", ".graphql", ".gql")
def graphql(source: str) -> list[Fact]:
    text = masked(source, r"#[^\n]*")
    return [fact("graphql_operation", text, m.start(), m[2], value=m[1]) for m in re.finditer(r"\b(query|mutation|subscription)\s+(\w+)", text)]


@parser("env", ".env", ".properties")
def environment(source: str) -> list[Fact]:
    """KEY=VALUE lines as aliases."""
    out = []
    for k, line in enumerate(source.split("\n"), 1):
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][\w.-]*)\s*=\s*(.*?)\s*$", line)
        if m and m[2] and not line.lstrip().startswith("#"):
            out.append(("alias", m[1], "", "", m[2].strip("'\""), k))
    return out


def flat(value, at: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for key, held in value.items():
            yield from flat(held, f"{at}:{key}" if at else key)
    elif isinstance(value, str) and value:
        yield at, value


@parser("json", ".json")
def settings(source: str) -> list[Fact]:
    """Serverless bindings and host settings, gateway workflows, else string settings as aliases; what isn't JSON has no facts."""
    try:
        held = json.loads(source)
    except ValueError:
        return []
    out: list[Fact] = []
    if isinstance(held, dict) and isinstance(held.get("bindings"), list):
        for b in held["bindings"]:
            if not isinstance(b, dict):
                continue
            kind = str(b.get("type", "")).lower()
            if kind == "httptrigger":
                out += [("trigger", m.upper(), "", b.get("route", ""), "http", 1) for m in b.get("methods", ["request"])]
            elif kind.endswith("trigger"):
                out.append(("trigger", b.get("queueName") or b.get("topicName") or b.get("schedule", ""), "", "", kind.removesuffix("trigger"), 1))
        return out
    if isinstance(held, dict) and isinstance(held.get("extensions"), dict):
        web = held["extensions"].get("http")
        prefix = web.get("routePrefix") if isinstance(web, dict) else None
        return [("route_prefix", "" if prefix is None else prefix, "", "", "", 1)]
    if isinstance(held, dict) and isinstance(held.get("paths"), dict):
        return [("gateway_route", method.upper(), "", path, "", 1) for path, ops in held["paths"].items() if isinstance(ops, dict) for method in ops]
    return [("alias", key, "", "", value, 1) for key, value in flat(held)] if isinstance(held, dict) else []


@parser("xml", ".xml", ".edmx")
def xml(source: str) -> list[Fact]:
    """Mapper statements as table accesses, entity models as entities, gateway policies as backends; broken XML has no facts."""
    try:
        root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(?:\[.*?\])?>", "", source, flags=re.S))
    except ElementTree.ParseError:
        return []
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    out: list[Fact] = []
    for e in root.iter():
        if tag(root) == "mapper" and tag(e) in ("select", "insert", "update", "delete"):
            own = f"{root.get('namespace', '')}.{e.get('id', '')}"
            out += [("data_access", t, own, "", a, 1) for t, a, _ in table_accesses(" ".join(e.itertext()))]
        elif tag(e) == "EntitySetMapping":
            store = [x.get("StoreEntitySet") for x in e.iter() if x.get("StoreEntitySet")]
            out += [("entity", e.get("Name", ""), "", s, "", 1) for s in store]
        elif tag(e) == "set-backend-service":
            out.append(("gateway_backend", e.get("base-url", ""), "", "", "", 1))
    return out


def endings(path: str) -> tuple[str, Callable[[str], list[Fact]]] | None:
    dot = path.rfind(".")
    return PARSERS.get(path[dot:].lower()) if dot >= 0 else None


def parse_files(files: DataFrame) -> DataFrame:
    """Facts of files (repo, path, text). Files without a parser give none; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in FACTS.split(", ")]
        types = [pa.string()] * 8 + [pa.int32()]
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and path and (held := endings(path)):
                    try:
                        rows += [(repo, path, held[0], *f) for f in held[1](text)]
                    except Exception as failed:  # noqa: BLE001  a file that a parser can't take is a fact, not the end of all files
                        rows.append((repo, path, held[0], "parse_error", type(failed).__name__, "", "", str(failed)[:200], 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("repo", "path", "text").mapInArrow(run, FACTS)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Files (repo, path, text) below root, a repository for each child folder; vendored and build folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rest = F.regexp_replace("path", "^.*?" + re.sub(r"([^\w/-])", r"\\\1", base) + "/", "")
    rows = files.filter(F.contains(rest, F.lit("/"))).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("repo"), F.regexp_replace(rest, "^[^/]+/", "").alias("path"), F.col("content").cast("string").alias("text"))
    return rows.filter(~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, VENDORED)) + ")/"))
