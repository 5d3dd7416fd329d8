"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and a mask of failed rules; a policy
is a named, versioned mask, and a document is kept under it if no bit of the policy is set in its mask. Policies
can thus be changed, compared and ablated from the ledger alone, without reading a text again.

Defined results: a null or empty text has no words and fails TOO_FEW_WORDS; repeated rows get equal rows; an empty
table gives an empty ledger; columns besides the id and the text are not looked at. Very long texts are measured whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util as u

TOO_FEW_WORDS, REPEATED_WORDS, MANY_SYMBOLS, REPEATED_LINES, ODD_WORDS = 1, 2, 4, 8, 16

#: name -> (bit, when it fails, in words that SQL and Python share); measurements are whole numbers, so every engine agrees.
RULES = {
    "too_few_words": (TOO_FEW_WORDS, "n_words < 50"),
    "repeated_words": (REPEATED_WORDS, "100 * n_repeat_words > 50 * n_words"),
    "many_symbols": (MANY_SYMBOLS, "100 * n_symbols > 10 * n_words"),
    "repeated_lines": (REPEATED_LINES, "100 * n_dup_lines > 50 * n_lines"),
    "odd_words": (ODD_WORDS, "word_chars < 2 * n_words or word_chars > 15 * n_words"),
}
BASE = TOO_FEW_WORDS | REPEATED_WORDS
#: Versioned policies: the rules that a document must pass.
POLICIES = {
    "base-1": BASE,
    "prose-1": BASE | MANY_SYMBOLS | ODD_WORDS,
    "prose-2": BASE | MANY_SYMBOLS | ODD_WORDS | REPEATED_LINES,
}
DEFAULT_POLICY = "prose-2"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """MEASURES of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    space = sum(map(text.count, u.SPACE))
    lines = [x for x in text.split("\n") if x.strip(u.SPACE)]
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen: set = set()
            twice: set = set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            end = 0  # words before this index are counted already
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, len(text) - space, sum(map(text.count, u.SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])
    for b in batches:
        for x in u.pieces(b):
            yield u.batch(schema, [x.column(0), *zip(*map(measure, x.column(1).to_pylist()), strict=True)])


def mask(rules: dict = RULES, names: dict | None = None) -> Column:
    """The failed rules as a mask of bits, from the measurements (names: what their columns are called)."""
    out = F.lit(0)
    for bit, fails in rules.values():
        fails = re.sub(r"\b[a-z_]+\b", lambda m: f"`{names[m[0]]}`" if names and m[0] in names else m[0], fails)
        out = out.bitwiseOR(F.when(F.expr(fails), bit).otherwise(0))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """One row per document: doc_id, MEASURES and `failed`, the mask of failed rules."""
    cols = u.id_text(docs, id_col, text_col)
    return cols.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)).withColumn("failed", mask(rules))


def verdict(policy: str | int = DEFAULT_POLICY, column: str = "failed") -> Column:
    """Whether a ledger row passes the policy."""
    return F.col(column).bitwiseAND(POLICIES[policy] if isinstance(policy, str) else policy) == 0


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY, rules: dict = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, documents that fail nothing else of it (what dropping the
    rule would bring back), and documents kept without it. One pass: rows are first counted by mask."""
    chosen = POLICIES[policy]
    masks = rows.groupBy(F.col("failed").bitwiseAND(chosen).alias("failed")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, (bit, _) in rules.items() if bit & chosen]))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return (
        masks.select("failed", "n", each.alias("r"))
        .groupBy("r.rule")
        .agg(
            count(F.col("failed").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            count(F.col("failed") == F.col("r.bit")).alias("n_only"),
            count((F.col("failed") == 0) | (F.col("failed") == F.col("r.bit"))).alias("n_kept_without"),
        )
        .withColumn("policy", F.lit(policy))
    )


def keep(docs: DataFrame, policy: str | int = DEFAULT_POLICY, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """The rows of docs, all columns, that pass the policy: each row is measured once where it is, all rules give its
    mask, and the policy is applied to the mask. One pass, no shuffle. Of equal masks all or none are kept."""
    names = {m: u.fresh(f"m_{m}", docs) for m in MEASURES}
    at, columns = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b):
                found = zip(*(measure(t or "") for t in x.column(at).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*x.columns, *(pa.array(f, type=pa.int64()) for f in found)], names=[*columns, *names.values()])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names.values())])
    failed = u.fresh("failed", docs)
    measured = docs.mapInArrow(run, schema)
    return measured.withColumn(failed, mask(rules, names)).where(verdict(policy, failed)).select(*[F.col(f"`{c}`") for c in columns])
