"""Scalar functions as column expressions. All stay in generated code; none is a Python UDF."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of a file by its suffix.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".go": "go",
    ".java": "java",
    ".rs": "rust",
    ".c": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
}
#: Directories that a source scan leaves out.
SKIPPED_DIRS = ("venv", ".venv", "env", ".env", ".git", ".svn", ".hg", "__pycache__", "node_modules", "build", "dist", ".idea", ".vscode")

HIGH, MEDIUM = 0.85, 0.70


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a path, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """The language of a path, null for others."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])
    return F.try_element_at(table, suffix(path))


def in_skipped_dir(path: Column) -> Column:
    """Whether a directory of the path (not the file itself) is one that scans leave out."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_DIRS)))


def row_hash(path: Column, name: Column, start: Column, end: Column) -> Column:
    """The stable key of a source function or call: 16 hex digits."""
    return F.substring(F.sha2(F.concat_ws(":", path, name, start.cast("string"), end.cast("string")), 256), 1, 16)


def unquoted(raw: Column) -> Column:
    """A string literal without its triple quotes, or without one character at each end if it starts with a quote."""
    n = F.length(raw)
    triple = raw.startswith('"""') | raw.startswith("'''")
    quoted = F.substring(raw, 1, 1).isin('"', "'", "`")
    return (
        F.when(n < 2, raw)
        .when(triple, F.when(n > 6, raw.substr(F.lit(4), F.greatest(n - 6, F.lit(0)))).otherwise(F.lit("")))
        .when(quoted, raw.substr(F.lit(2), F.greatest(n - 2, F.lit(0))))
        .otherwise(raw)
    )


def from_hex(address: Column) -> Column:
    """0x-prefixed hex text to a long; null where it isn't hex."""
    digits = F.regexp_extract(F.trim(address), r"^(?:0[xX])?([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long"))


def to_hex(offset: Column) -> Column:
    """0x and at least eight lower-case digits."""
    digits = F.lower(F.hex(offset))
    return F.concat(F.lit("0x"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))


def is_library(name: Column, thunk: Column, external: Column) -> Column:
    """1 for thunks, externals and functions whose name isn't one that a disassembler makes up."""
    return F.when(thunk | external, 1).when(~(name.startswith("FUN_") | name.startswith("SUB_")), 1).otherwise(0)


def bucket(confidence: Column) -> Column:
    return F.when(confidence > HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def ref_type(method: Column) -> Column:
    return F.when(F.instr(method, "indirect") > 0, "indirect").otherwise("direct")


def size_similarity(one: Column, two: Column) -> Column:
    """The smaller over the larger; 0.5 if a size isn't known."""
    return F.when((one > 0) & (two > 0), F.least(one, two) / F.greatest(one, two)).otherwise(0.5)


def name_contains(name: Column, text: str) -> Column:
    """LIKE '%text%' as SQLite has it: letters of ASCII match in either case, % and _ stay live, nothing escapes."""
    return name.ilike("%" + text.replace("\\", "\\\\") + "%")
