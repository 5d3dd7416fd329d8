"""The driver's tables as inputs of the operators. Ids keep the sides apart: even documents are the source side, odd ones
the binary side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.operators.lineage import cut

from .state import Inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_strings(spark: SparkSession, sf_dir: str, pattern: str = "\n") -> DataFrame:
    """func_id, s, side: the distinct trimmed pieces of documents, of five characters or more. The pieces of a row are made
    distinct in its array; only where an id has more than one row are the texts shuffled."""
    docs = table(spark, sf_dir, "documents")
    each = F.array_distinct(F.transform(F.split("text", pattern), lambda x: F.trim(x)))
    pieces = docs.select(F.col("doc_id").alias("func_id"), F.explode(each).alias("s"))
    pieces = pieces.select("func_id", "s", (F.col("func_id") % 2).alias("side")).where(F.length("s") >= 5)
    again = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return pieces.distinct() if again else pieces


def sides(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(binary, source) rows func_id, s."""
    return strings.where("side = 1").select("func_id", "s"), strings.where("side = 0").select("func_id", "s")


def by_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sides(line_strings(spark, sf_dir))


def by_sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sides(line_strings(spark, sf_dir, "[.\n]"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(binary edges, source edges, seeds): suppliers call parts; a tenth of the orders is missing on the binary side,
    and nodes whose number ends in 0 aren't mapped yet."""
    lines = table(spark, sf_dir, "lineitem")
    edge = lambda df: df.select(F.col("l_suppkey").alias("caller_id"), (F.lit(100000) + F.col("l_partkey")).alias("callee_id")).distinct()
    src, bins = cut(edge(lines)), cut(edge(lines.where("l_orderkey % 10 <> 0")))
    nodes = bins.select(F.col("caller_id").alias("bin_id")).unionByName(bins.select(F.col("callee_id").alias("bin_id"))).distinct()
    return bins, src, nodes.where("bin_id % 10 <> 0").select("bin_id", F.col("bin_id").alias("src_id"))


def document_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(binary edges, source edges) over document ids: order lines link the documents numbered by supplier and part."""
    lines = table(spark, sf_dir, "lineitem")
    edge = lambda df, side: df.select((F.col("l_suppkey") * 2 + side).alias("caller_id"), (F.col("l_partkey") * 2 + side).alias("callee_id")).where("caller_id <> callee_id").distinct()
    return edge(lines.where("l_orderkey % 10 <> 0"), 1), edge(lines, 0)


def document_inputs(spark: SparkSession, sf_dir: str, keep: bool = True) -> Inputs:
    """keep: strings are checkpointed. The v2 pipeline reads texts twice only, so it does without."""
    docs = table(spark, sf_dir, "documents")
    info = docs.select("doc_id", "n_chars", "source", "lang")
    bins = info.where("doc_id % 2 = 1").select(F.col("doc_id").alias("bin_id"), F.lit(None).cast("string").alias("name"), F.col("n_chars").alias("size"), F.format_string("0x%08x", "doc_id").alias("address"))
    srcs = info.where("doc_id % 2 = 0").select(F.col("doc_id").alias("src_id"), F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("name"), F.col("n_chars").alias("size"), F.col("lang").alias("file_path"))
    strings = line_strings(spark, sf_dir, "[.\n]")
    strings = cut(strings) if keep else strings
    return Inputs.of(bins, srcs, *sides(strings), *document_edges(spark, sf_dir))


def error_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(refs, calls) of the as-of join: errors refer, purchases are calls; addresses are microseconds."""
    events = table(spark, sf_dir, "events")
    addr = F.unix_micros(F.col("ts").cast("timestamp")).alias("addr")
    refs = events.where("event_type = 'error'").select(F.col("user_id").alias("func"), addr, "ts", F.col("event_id").alias("ref_event_id"))
    calls = events.where("event_type = 'purchase'").select(F.col("user_id").alias("func"), addr, F.col("event_id").alias("seq"), F.col("event_id").alias("callee"))
    return refs, calls


def order_brands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, strings): orders call parts, which own their brand."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller_id"), F.col("l_partkey").alias("callee_id")).distinct()
    return edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("func_id"), F.col("p_brand").alias("s")).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, raw: the quoted values of href attributes."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href=("[^"]*")'), 1)).alias("raw"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, lang, content: a small C file for each supplier, with one definition and two calls."""
    text = F.format_string('/* call("no") */\nint fn_%d(int x) {\n  if (x) {\n    log_it("%s", x);\n  }\n  return g%d(x);\n}\n', "s_suppkey", "s_name", F.col("s_suppkey") % 7)
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("/src/"), F.col("s_suppkey").cast("string"), F.lit(".c")).alias("file_path"), F.lit("c").alias("lang"), text.cast("binary").alias("content"))
