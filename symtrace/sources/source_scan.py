"""Source trees: which files, which language, and their functions, calls and strings.

Files are read by Spark's binaryFile source and parsed in Arrow batches. Functions, calls and string literals come from
a small lexer of the brace languages (C, C++, Go, Java, JavaScript, TypeScript, Rust) and of Python, as a full grammar
isn't at hand; a file that can't be parsed gives one error row and no others, and the job goes on.

Only plain names are recorded, as definitions and as calls: methods of classes (JavaScript, TypeScript, Go), destructors,
operators and functions behind a qualified name have none, and an arrow function has that of its one bare parameter.

Who calls: by default the function opened last before the call in the file (`last_opened`), or, with `enclosing`, the
innermost function whose body holds the call.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.functions import scalars

#: Names that are no functions.
KEYWORDS = frozenset(
    "if else elif switch case default for while do break continue return try catch finally throw raise except class struct enum union typedef "
    "import export from as with using and or not in is lambda true false null nil none new delete sizeof typeof instanceof public private protected "
    "static const let var void int char float double bool string goto volatile register extern inline async await yield match".split()
)
#: Languages whose calls are recorded, and those whose calls bring their string arguments.
WITH_CALLS = frozenset({"c", "cpp", "go", "rust", "javascript", "typescript"})
WITH_STRINGS = frozenset({"c", "cpp", "go"})
DEFINES = {
    "go": re.compile(r"\bfunc\s+([A-Za-z_]\w*)\s*$"),
    "rust": re.compile(r"\bfn\s+([A-Za-z_]\w*)(?:<[^{}()]*>)?\s*$"),
    "javascript": re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*$"),
    "typescript": re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)(?:<[^{}()]*>)?\s*$"),
}
#: What introduces a function without its name, or a method whose name isn't recorded: no calls.
OPENERS = {"go": frozenset({"func"}), "rust": frozenset({"fn"}), "javascript": frozenset({"function"}), "typescript": frozenset({"function"})}
GO_METHOD = re.compile(r"\bfunc\s*\([^()]*\)\s*$")
ARROW_FUNCTION = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*=>\s*\{")
NAME = re.compile(r"([A-Za-z_$][\w$]*)(?:<[^<>(){};]*>)?\s*$")
PYTHON_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)[ \t]*\(", re.M)
SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", re.S | re.M)

SCHEMA = "file_path string, kind string, name string, line_start int, line_end int, preorder int, hash string, caller_hash string, strings array<string>, error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "string": pa.string()}.get(c.split()[1], pa.list_(pa.string()))) for c in SCHEMA.split(", ")])


def literal(raw: str) -> str:
    """A literal without its quotes, as in scalars.unquoted."""
    if len(raw) >= 2:
        if raw.startswith(('"""', "'''")):
            return raw[3:-3]
        if raw[0] in "\"'`":
            return raw[1:-1]
    return raw


def parse(text: str, lang: str) -> list[dict]:
    """Definitions and calls in the order they begin: kind, name, line_start, line_end, at, end, strings."""
    if lang == "python":
        return _python(text)
    blank = SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: _line(lines, at)
    pair: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[(){}]", blank):
        if m[0] in "({":
            stack.append(m.start())
        elif stack:
            pair[stack.pop()] = m.start()
    out, defined = [], set()
    for m in re.finditer(r"\(", blank):
        start = m.start()
        close = pair.get(start)
        name = NAME.search(blank, max(0, start - 200), start)
        if close is None or name is None or name[1].lower() in KEYWORDS or name[1] in OPENERS.get(lang, ()):
            continue
        body = re.compile(r"[^;{}()=]*\{").match(blank, close + 1)
        head = DEFINES.get(lang)
        is_def = body is not None and (head.search(blank[max(0, start - 200) : start]) is not None if head else re.search(r"[\w*&>\]]\s*$", blank[max(0, name.start() - 80) : name.start()]) is not None)
        if is_def:
            brace = body.end() - 1
            end = pair.get(brace, len(blank) - 1)
            defined.add(start)
            out.append({"kind": "def", "name": name[1], "line_start": line(brace), "line_end": line(end), "at": name.start(1), "end": end, "strings": []})
        elif lang in WITH_CALLS and not re.search(r"[.>:]\s*$", blank[max(0, name.start(1) - 3) : name.start(1)]):
            before = blank[max(0, name.start(1) - 20) : name.start(1)]
            if re.search(r"\b(?:func|fn|function|new)\s+\*?$", before) or lang == "go" and GO_METHOD.search(blank[max(0, start - 200) : name.start(1)]):
                continue
            if body is not None and lang in ("javascript", "typescript"):
                continue  # a method: conditions are in parentheses there, so no call stands before a brace
            strings = [literal(s[0]) for s in SKIP.finditer(text, start + 1, close) if s[0][0] in '"`'] if lang in WITH_STRINGS else []
            at = line(name.start(1))
            out.append({"kind": "call", "name": name[1], "line_start": at, "line_end": at, "at": name.start(1), "end": close, "strings": strings})
    if lang in ("javascript", "typescript"):
        for m in ARROW_FUNCTION.finditer(blank):
            if m[1].lower() not in KEYWORDS:
                end = pair.get(m.end() - 1, len(blank) - 1)
                out.append({"kind": "def", "name": m[1], "line_start": line(m.end() - 1), "line_end": line(end), "at": m.start(1), "end": end, "strings": []})
    return sorted(out, key=lambda r: r["at"])


def _line(starts: list[int], at: int) -> int:
    import bisect

    return bisect.bisect_right(starts, at)


def _python(text: str) -> list[dict]:
    """Definitions only: calls of Python are no call expressions of the kind that is recorded."""
    rows, all_lines = [], text.split("\n")
    for m in PYTHON_DEF.finditer(text):
        first = text.count("\n", 0, m.start()) + 1
        indent = len(m[1].expandtabs())
        header = first
        while header <= len(all_lines) and not re.search(r":\s*(#.*)?$", all_lines[header - 1]):
            header += 1
        last = start = min(header + 1, len(all_lines))
        for k in range(header, len(all_lines)):
            x = all_lines[k]
            if x.strip() and len(x.expandtabs()) - len(x.expandtabs().lstrip()) <= indent:
                break
            if x.strip():
                last = k + 1
        if m[2].lower() not in KEYWORDS:
            rows.append({"kind": "def", "name": m[2], "line_start": start, "line_end": max(last, start), "at": m.start(2), "end": sum(len(x) + 1 for x in all_lines[:last]), "strings": []})
    return rows


def records(path: str, text: str, lang: str, attribution: str = "last_opened") -> list[dict]:
    """parse() with the hashes of rows and of their callers."""
    rows = parse(text, lang)
    opened: list[dict] = []
    for k, r in enumerate(rows):
        r["preorder"] = k
        r["hash"] = hashlib.sha256(f"{path}:{r['name']}:{r['line_start']}:{r['line_end']}".encode()).hexdigest()[:16]
        r["caller_hash"] = None
        if r["kind"] == "def":
            opened.append(r)
        elif attribution == "last_opened":
            r["caller_hash"] = opened[-1]["hash"] if opened else None
        else:
            holds = [d for d in opened if d["end"] >= r["at"]]
            r["caller_hash"] = holds[-1]["hash"] if holds else None
    return rows


def scan(spark: SparkSession, path: str) -> DataFrame:
    """file_path, lang, length, content of the source files under a directory, or of the one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    clean = F.regexp_replace("path", r"^file:/*", "/")
    root = "/" + path.removeprefix("file:").strip("/")
    below = F.when(clean.startswith(root + "/"), clean.substr(F.lit(len(root) + 1), F.length(clean))).otherwise(clean)
    return files.select(clean.alias("file_path"), scalars.language(clean).alias("lang"), "length", "content").where(F.col("lang").isNotNull() & ~scalars.in_skipped_dir(below))


def parsed(files: DataFrame, attribution: str = "last_opened") -> DataFrame:
    """SCHEMA rows of files (file_path, lang, content); kind is def, call or error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, lang, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows = records(path, content.decode("utf-8", "replace"), lang, attribution)
                    out += [{"file_path": path, **{c: r.get(c) for c in COLUMNS[1:]}} for r in rows]
                except Exception as e:  # one file must not end the job
                    out.append({"file_path": path, "kind": "error", "strings": [], "error": repr(e)[:200]})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return files.select("file_path", "lang", "content").mapInArrow(run, SCHEMA)


def source_relations(rows: DataFrame) -> dict[str, DataFrame]:
    """functions, strings, function_string_map, source_call_graph from parsed rows."""
    from . import store

    good = rows.where("kind <> 'error'")
    functions = good.select("name", "file_path", "line_start", "line_end", "hash", (F.col("kind") == "def").cast("int").alias("is_def"))
    uses = good.select("hash", F.explode("strings").alias("content")).where("content <> ''")
    calls = good.where("kind = 'call' and caller_hash is not null").select("caller_hash", F.col("hash").alias("callee_hash"), F.col("line_start").alias("call_line"))
    return store.merge_sources(functions, uses.select("content"), uses.groupBy("hash", "content").agg(F.count("*").alias("usage_count")), calls)


def last_opened(events: DataFrame, part: str, order: str, opener: str, value: str) -> DataFrame:
    """Rows of events with `caller`: the value of the last opener before them in their part."""
    from pyspark.sql import Window

    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("caller", F.last(F.when(F.col(opener), F.col(value)), ignorenulls=True).over(w))
