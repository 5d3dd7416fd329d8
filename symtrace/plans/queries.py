"""Every operator over the driver's tables, and the same in SQL. Floats are rounded to six digits on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.functions import scalars
from symtrace.operators import assign, features, similarity
from symtrace.operators.lineage import cut
from symtrace.sources import extract, relations, source_scan, store

from . import engine, report, v2, v3
from . import fixtures as fx
from .state import Inputs, State

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers the decorated function with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and the executors share."""
    cut(spark.range(1))  # the checkpoint folder exists from here on
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


r6 = lambda c: F.round(c, 6).alias(c)


def _f1(pieces: str) -> str:
    return rf"""fs AS (SELECT DISTINCT doc_id AS func_id, trim(l) AS s, doc_id % 2 AS side FROM (SELECT doc_id, unnest({pieces}) AS l FROM documents) WHERE length(trim(l)) >= 5),
b AS (SELECT func_id, s FROM fs WHERE side = 1), c AS (SELECT func_id, s FROM fs WHERE side = 0)"""


LINES = _f1("string_split(text, chr(10))")
SENTENCES = _f1("regexp_split_to_array(text, '[.\\n]')")
EVIDENCE = """ub AS (SELECT s, min(func_id) AS bin_id FROM b GROUP BY s HAVING count(*) = 1), uc AS (SELECT s, min(func_id) AS src_id FROM c GROUP BY s HAVING count(*) = 1),
ev AS (SELECT bin_id, src_id, count(*) AS evidence FROM ub JOIN uc USING (s) GROUP BY 1, 2)"""
IDF = """nn AS (SELECT greatest(count(DISTINCT func_id), 1) AS n FROM b), idf AS (SELECT s, ln((n + 1.0) / (count(*) + 1.0)) AS idf FROM b, nn GROUP BY s, n),
bw AS (SELECT b.func_id, b.s, coalesce(idf, 1.0) AS w FROM b LEFT JOIN idf USING (s)), cw AS (SELECT c.func_id, c.s, coalesce(idf, 1.0) AS w FROM c LEFT JOIN idf USING (s)),
tb AS (SELECT func_id AS bin_id, count(*) AS n_a, sum(w) AS w_a FROM bw GROUP BY 1), tc AS (SELECT func_id AS src_id, count(*) AS n_b, sum(w) AS w_b FROM cw GROUP BY 1),
ov AS (SELECT bw.func_id AS bin_id, cw.func_id AS src_id, count(*) AS n_i, sum(bw.w) AS w_i FROM bw JOIN cw USING (s) GROUP BY 1, 2),
sim AS (SELECT bin_id, src_id, n_i AS shared, n_i / CAST(n_a + n_b - n_i AS DOUBLE) AS jaccard, CASE WHEN round(w_a + w_b - w_i, 12) > 0 THEN w_i / (w_a + w_b - w_i) ELSE 0.0 END AS weighted
  FROM ov JOIN tb USING (bin_id) JOIN tc USING (src_id))"""


def greedy_sql(source: str, weight: str, rounds: int, t: str = "") -> str:
    """CTEs of the iterated mutual best over source (bin_id, src_id, weight), their names ending in t; `matched` is their union."""
    out = [f"e0{t} AS (SELECT bin_id, src_id, {weight} AS w FROM {source})"]
    for k in range(1, rounds + 1):
        p = f"e{k - 1}{t}"
        out.append(
            f"m{k}{t} AS (SELECT bin_id, src_id FROM (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY w DESC, bin_id, src_id) AS rb, row_number() OVER (PARTITION BY src_id ORDER BY w DESC, bin_id, src_id) AS rs FROM {p}) WHERE rb = 1 AND rs = 1)"
        )
        out.append(f"e{k}{t} AS (SELECT * FROM {p} WHERE bin_id NOT IN (SELECT bin_id FROM m{k}{t}) AND src_id NOT IN (SELECT src_id FROM m{k}{t}))")
    return ", ".join(out) + f", matched{t} AS (" + " UNION ALL ".join(f"SELECT * FROM m{k}{t}" for k in range(1, rounds + 1)) + ")"


GRAPH = """se AS (SELECT DISTINCT l_suppkey AS caller_id, 100000 + l_partkey AS callee_id FROM lineitem), be AS (SELECT DISTINCT l_suppkey AS caller_id, 100000 + l_partkey AS callee_id FROM lineitem WHERE l_orderkey % 10 <> 0),
nodes AS (SELECT caller_id AS id FROM be UNION SELECT callee_id FROM be), seeds AS (SELECT id AS bin_id, id AS src_id FROM nodes WHERE id % 10 <> 0)"""


def _side_sql(name: str, own: str, other: str, t: str = "", pairs: str = "pairs", seeds: str = "seeds", be: str = "be", se: str = "se") -> str:
    return f"""{name}m{t} AS (SELECT DISTINCT {own} AS bin_id, src_id AS ns FROM {be} JOIN {seeds} z ON z.bin_id = {other}), {name}s{t} AS (SELECT DISTINCT {own} AS src_id, {other} AS ns FROM {se}),
{name}{t} AS (SELECT p.bin_id, p.src_id, coalesce(a.n, 0) AS n_m, coalesce(z.n, 0) AS n_s, coalesce(i.n, 0) AS n_i FROM {pairs} p
  LEFT JOIN (SELECT bin_id, count(*) AS n FROM {name}m{t} GROUP BY 1) a USING (bin_id) LEFT JOIN (SELECT src_id, count(*) AS n FROM {name}s{t} GROUP BY 1) z USING (src_id)
  LEFT JOIN (SELECT q.bin_id, q.src_id, count(*) AS n FROM (SELECT DISTINCT bin_id, src_id FROM {pairs}) q JOIN {name}m{t} m ON m.bin_id = q.bin_id JOIN {name}s{t} s ON s.src_id = q.src_id AND s.ns = m.ns GROUP BY 1, 2) i ON i.bin_id = p.bin_id AND i.src_id = p.src_id)"""


def call_sql(t: str = "", **names: str) -> str:
    """CTEs whose last is calls (bin_id, src_id, call), their names ending in t; names: what pairs, seeds, be, se are called."""
    return f"""{_side_sql("up", "callee_id", "caller_id", t, **names)}, {_side_sql("dn", "caller_id", "callee_id", t, **names)},
calls{t} AS (SELECT DISTINCT bin_id, src_id, (coalesce(up{t}.n_i / CAST(nullif(up{t}.n_m + up{t}.n_s - up{t}.n_i, 0) AS DOUBLE), 0) + coalesce(dn{t}.n_i / CAST(nullif(dn{t}.n_m + dn{t}.n_s - dn{t}.n_i, 0) AS DOUBLE), 0)) / 2 AS call FROM up{t} JOIN dn{t} USING (bin_id, src_id))"""


CALL = call_sql()
UNSEEDED = "pairs AS (SELECT id AS bin_id, id AS src_id FROM nodes WHERE id % 10 = 0)"
#: Results of the reports: similar documents stand for exported matches.
RESULTS = f"""{LINES}, {IDF}, res AS (SELECT bin_id AS bin_func_id, printf('0x%08x', bin_id) AS bin_address, src_id AS src_func_id, 'src' || src_id || '_fn' AS src_func_name, round(0.35 * jaccard + 0.65 * weighted, 6) AS confidence,
  CASE WHEN weighted >= 0.6 THEN 'indirect_multi_string' ELSE 'string_set' END AS method, shared AS shared_strings FROM sim)"""


def _as_results(pairs: DataFrame, bin_id: str, src_id: str, *more: str) -> DataFrame:
    return pairs.select(
        F.col(bin_id).alias("bin_func_id"), F.format_string("0x%08x", bin_id).alias("bin_address"), F.col(src_id).alias("src_func_id"), F.concat(F.lit("src"), F.col(src_id).cast("string"), F.lit("_fn")).alias("src_func_name"),
        F.round(similarity.combined(F.col("jaccard"), F.col("weighted")), 6).alias("confidence"), F.when(F.col("weighted") >= 0.6, "indirect_multi_string").otherwise("string_set").alias("method"), F.col("shared").alias("shared_strings"), *more,
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_results(similarity.similarity(*fx.by_lines(spark, sf_dir)), "bin_id", "src_id")


def _by_class(spark: SparkSession, sf_dir: str) -> tuple[similarity.Shared, DataFrame]:
    """The results as classes of functions: their members, and bin_class, src_class, copies, confidence, method."""
    shared = similarity.shared_sets(*fx.by_lines(spark, sf_dir))
    return shared, _as_results(shared.classes(), "bin_class", "src_class", "bin_class", "src_class", "copies").select("bin_class", "src_class", "copies", "confidence", "method")


def _expanded(rows: DataFrame) -> DataFrame:
    """Rows (bin_id, src_id, confidence) with the columns of results that follow from the ids."""
    return rows.select(F.col("bin_id").alias("bin_func_id"), F.format_string("0x%08x", "bin_id").alias("bin_address"), F.col("src_id").alias("src_func_id"), F.concat(F.lit("src"), F.col("src_id").cast("string"), F.lit("_fn")).alias("src_func_name"), "confidence")


# Sources and scalars


@query(r"""SELECT DISTINCT page_id, substr(raw, 2, length(raw) - 2) AS s FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=("[^"]*")', 1)) AS raw FROM pages) WHERE substr(raw, 2, length(raw) - 2) <> ''""")
def src_string_dedup(spark, sf_dir):
    return fx.links(spark, sf_dir).select("page_id", scalars.unquoted(F.col("raw")).alias("s")).where("s <> ''").distinct()


@query("""SELECT ps_id, left(sha256(p_name || ':' || p_brand || ':' || CAST(p_size AS VARCHAR) || ':' || CAST(p_partkey AS VARCHAR)), 16) AS hash FROM (SELECT p_partkey AS ps_id, * FROM part)""")
def row_hash16(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ps_id"), scalars.row_hash(F.col("p_name"), F.col("p_brand"), F.col("p_size"), F.col("p_partkey")).alias("hash"))


_SUFFIX = "CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.C' WHEN 2 THEN '.h' WHEN 3 THEN '.Rs' WHEN 4 THEN '.tsx' WHEN 5 THEN '.hpp' WHEN 6 THEN '' ELSE '.java' END"


@query(f"""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'c' WHEN 3 THEN 'rust' WHEN 4 THEN 'typescript' WHEN 5 THEN 'cpp' WHEN 7 THEN 'java' END AS lang, doc_id % 3 = 0 AS skipped FROM documents WHERE {_SUFFIX} IS NOT NULL""")
def lang_detect(spark, sf_dir):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "/a/node_modules/").otherwise("/a/src.d/"), F.col("source"), F.expr(_SUFFIX))
    return fx.table(spark, sf_dir, "documents").select("doc_id", scalars.language(path).alias("lang"), scalars.in_skipped_dir(path).alias("skipped"))


@query("""SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 7 = 0 THEN 1 WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS is_library FROM supplier""")
def library_flag(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("FUN_"), F.col("s_name"))).otherwise(F.col("s_name"))
    return fx.table(spark, sf_dir, "supplier").select("s_suppkey", scalars.is_library(name, F.col("s_suppkey") % 7 == 0, F.lit(False)).alias("is_library"))


@query("""SELECT o_orderkey, printf('0x%08x', o_orderkey * 4096) AS address, o_orderkey * 4096 AS back FROM orders""")
def hex_addr_roundtrip(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", scalars.to_hex(F.col("o_orderkey") * 4096).alias("address"))
    return rows.withColumn("back", scalars.from_hex(F.col("address")))


@query(r"""SELECT doc_id, count(*) AS n_runs, CAST(sum(length(m)) AS BIGINT) AS total FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\x20-\x7E\t\n\r]{5,}')) AS m FROM documents) GROUP BY doc_id""")
def raw_strings(spark, sf_dir):
    runs = F.regexp_extract_all("text", F.lit(r"[\x20-\x7E\t\n\r]{5,}"), 0)
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(runs).alias("m"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.sum(F.length("m")).alias("total"))


@query("""SELECT l_partkey, l_suppkey, CAST(min(l_orderkey) AS BIGINT) AS first_order FROM lineitem GROUP BY 1, 2""")
def insert_ignore_dedup(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("first_order"))
    return store.insert_or_ignore(rows, ["l_partkey", "l_suppkey"], order=["first_order"])


@query("""SELECT l_partkey AS function_id, l_suppkey AS string_id, count(*) AS usage_count FROM lineitem GROUP BY 1, 2""")
def upsert_usage_count(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("function_id"), F.col("l_suppkey").alias("string_id"), F.lit(1).alias("usage_count"))
    return store.upsert_sum(rows, ["function_id", "string_id"], "usage_count")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer""")
def upsert_replace(spark, sf_dir):
    keys = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return store.upsert_replace(keys.withColumn("v", F.lit("old")), keys.where("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])


@query("""SELECT address, content FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY prio, content) AS r FROM (SELECT p_size AS address, p_brand AS content, 0 AS prio FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_size, p_type, 1 FROM part)) WHERE r = 1""")
def priority_merge(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return extract.priority_merge(part.where("p_partkey % 5 = 0").select(F.col("p_size").alias("address"), F.col("p_brand").alias("content")), part.select(F.col("p_size").alias("address"), F.col("p_type").alias("content")))


_MERGE = """f AS (SELECT hash, dense_rank() OVER (ORDER BY hash) AS id FROM (SELECT DISTINCT c_mktsegment || ':' || c_nationkey AS hash FROM customer)),
s AS (SELECT content, dense_rank() OVER (ORDER BY content) AS id FROM (SELECT DISTINCT c_mktsegment AS content FROM customer)),
u AS (SELECT c_mktsegment || ':' || c_nationkey AS hash, c_mktsegment AS content, 1 AS n FROM customer)"""


@query(f"""WITH {_MERGE} SELECT f.id AS function_id, s.id AS string_id, CAST(sum(n) AS BIGINT) AS usage_count FROM u JOIN f USING (hash) JOIN s USING (content) GROUP BY 1, 2""")
def merge_remap(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("hash"), F.col("c_mktsegment").alias("content"))
    none = spark.createDataFrame([], "caller_hash string, callee_hash string, call_line int")
    return store.merge_sources(c.select("hash"), c.select("content"), c.withColumn("usage_count", F.lit(1)), none)["function_string_map"]


@query(f"""WITH {_MERGE}, e AS (SELECT DISTINCT c_mktsegment || ':' || c_nationkey AS a, c_mktsegment || ':' || (c_custkey % 25) AS z, CAST(c_custkey % 9 AS INTEGER) AS call_line FROM customer)
SELECT x.id AS caller_id, y.id AS callee_id, call_line FROM e JOIN f x ON x.hash = a JOIN f y ON y.hash = z""")
def merge_remap_edges(spark, sf_dir):
    key = lambda n: F.concat_ws(":", "c_mktsegment", n.cast("string"))
    c = fx.table(spark, sf_dir, "customer").select(key(F.col("c_nationkey")).alias("hash"), key(F.col("c_custkey") % 25).alias("callee_hash"), F.col("c_mktsegment").alias("content"), (F.col("c_custkey") % 9).cast("int").alias("call_line"))
    calls = c.select(F.col("hash").alias("caller_hash"), "callee_hash", "call_line")
    return store.merge_sources(c.select("hash"), c.select("content"), c.select("hash", "content").withColumn("usage_count", F.lit(1)), calls)["source_call_graph"]


@query("""SELECT doc_id, CAST((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % 8 AS INTEGER) AS chunk FROM documents""")
def size_balanced_chunks(spark, sf_dir):
    return store.balanced(fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 8).select("doc_id", "chunk")


@query("""SELECT n_nationkey, CAST(length(n_name) AS INTEGER) AS length, 1 AS is_def FROM nation""")
def add_missing_columns(spark, sf_dir):
    old = fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return store.with_missing_columns(old, {"length": F.length("n_name"), "is_def": F.lit(1), "n_name": F.lit("")}).select("n_nationkey", "length", "is_def")


@query("""SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)""")
def fk_violations(spark, sf_dir):
    return store.violations(fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", fx.table(spark, sf_dir, "part").where("p_partkey % 10 <> 0"), "p_partkey").select("l_orderkey", "l_partkey")


_TABLES = ("orders", "lineitem", "documents", "pages")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES))
def row_counts(spark, sf_dir):
    return store.row_counts({t: fx.table(spark, sf_dir, t) for t in _TABLES})


@query("""SELECT func, ref_event_id, callee FROM (SELECT r.user_id AS func, r.event_id AS ref_event_id, c.event_id AS callee, c.ts - r.ts AS d FROM (SELECT * FROM events WHERE event_type = 'error') r
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON r.user_id = c.user_id AND r.ts < c.ts) WHERE d <= INTERVAL 720 MINUTE""")
def asof_next_call(spark, sf_dir):
    refs, calls = fx.error_calls(spark, sf_dir)
    return extract.next_call(refs.drop("ts"), calls, 720 * 60 * 1_000_000).where("callee is not null").select("func", "ref_event_id", "callee")


@query("""WITH j AS (SELECT r.user_id AS func, r.event_id AS string_id, CASE WHEN c.ts - r.ts <= INTERVAL 720 MINUTE THEN c.event_id END AS callee FROM (SELECT * FROM events WHERE event_type = 'error') r
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON r.user_id = c.user_id AND r.ts < c.ts)
SELECT DISTINCT func AS func_id, string_id, 'indirect' AS ref_type FROM j UNION SELECT callee, string_id, 'direct' FROM j WHERE callee IS NOT NULL""")
def ref_fanout(spark, sf_dir):
    refs, calls = fx.error_calls(spark, sf_dir)
    joined = extract.next_call(refs.drop("ts"), calls, 720 * 60 * 1_000_000).withColumnRenamed("ref_event_id", "string")
    return extract.ref_fanout(joined).select("func_id", "string_id", "ref_type")


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role <> 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS caller FROM conversations""")
def last_opened_caller(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").withColumn("opens", F.col("role") != "user")
    return source_scan.last_opened(turns, "conv_id", "turn", "opens", "turn").select("conv_id", "turn", F.coalesce("caller", F.lit(-1)).alias("caller"))


@query("""SELECT o_orderkey AS addr, s_suppkey AS id FROM orders JOIN (SELECT s_suppkey, s_suppkey * 500 AS lo, s_suppkey * 500 + 199 AS hi FROM supplier) ON o_orderkey BETWEEN lo AND hi""")
def enclosing_interval(spark, sf_dir):
    ranges = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 500).alias("lo"), (F.col("s_suppkey") * 500 + 199).alias("hi"))
    return extract.containing(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("addr")), ranges).select("addr", "id")


@query("""SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 2 = 0 AND l_suppkey <> l_partkey""")
def call_edges(spark, sf_dir):
    refs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("func"), F.col("l_partkey").alias("target"))
    return extract.call_edges(refs, fx.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("entry")))


@query("""SELECT count(*) FILTER (ok) AS resolved, count(*) FILTER (NOT ok) AS skipped FROM (SELECT l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0) AS ok FROM lineitem)""")
def address_resolution(spark, sf_dir):
    hexed = lambda c: scalars.to_hex(F.col(c))
    ids = fx.table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), hexed("p_partkey").alias("address"))
    found, lost = extract.resolve(fx.table(spark, sf_dir, "lineitem").select(hexed("l_partkey").alias("callee")), ids, "callee")
    return found.agg(F.count("*").alias("resolved")).crossJoin(F.broadcast(lost.agg(F.count("*").alias("skipped"))))


_PARSED = """SELECT '/src/' || s_suppkey || '.c' AS file_path, unnest([
  struct_pack(kind := 'def', name := 'fn_' || s_suppkey, a := 2, z := 7, strings := CAST([] AS VARCHAR[])), struct_pack(kind := 'call', name := 'log_it', a := 4, z := 4, strings := [s_name]),
  struct_pack(kind := 'call', name := 'g' || (s_suppkey % 7), a := 6, z := 6, strings := CAST([] AS VARCHAR[]))]) AS r, left(sha256('/src/' || s_suppkey || '.c:fn_' || s_suppkey || ':2:7'), 16) AS opener FROM supplier"""


@query(f"""SELECT file_path, r.kind AS kind, r.name AS name, CAST(r.a AS INTEGER) AS line_start, CAST(r.z AS INTEGER) AS line_end, left(sha256(file_path || ':' || r.name || ':' || r.a || ':' || r.z), 16) AS hash, CASE WHEN r.kind = 'call' THEN opener END AS caller_hash FROM ({_PARSED})""")
def parsed_source(spark, sf_dir):
    return source_scan.parsed(fx.source_files(spark, sf_dir)).select("file_path", "kind", "name", "line_start", "line_end", "hash", "caller_hash")


@query(f"""SELECT DISTINCT unnest(r.strings) AS content, r.name AS name, file_path FROM ({_PARSED})""")
def call_strings(spark, sf_dir):
    tables = source_scan.source_relations(source_scan.parsed(fx.source_files(spark, sf_dir)))
    functions = tables["functions"].select(F.col("id").alias("function_id"), "name", "file_path")
    strings = tables["strings"].select(F.col("id").alias("string_id"), "content")
    return tables["function_string_map"].join(functions, "function_id").join(strings, "string_id").select("content", "name", "file_path")


@query(f"""SELECT a.name AS caller, b.name AS callee, b.line AS call_line FROM (SELECT file_path, r.name AS name FROM ({_PARSED}) WHERE r.kind = 'def') a JOIN (SELECT file_path, r.name AS name, CAST(r.a AS INTEGER) AS line FROM ({_PARSED}) WHERE r.kind = 'call') b USING (file_path)""")
def source_call_graph(spark, sf_dir):
    tables = source_scan.source_relations(source_scan.parsed(fx.source_files(spark, sf_dir)))
    name = lambda i, n: tables["functions"].select(F.col("id").alias(i), F.col("name").alias(n))
    return tables["source_call_graph"].join(name("caller_id", "caller"), "caller_id").join(name("callee_id", "callee"), "callee_id").select("caller", "callee", "call_line")


@query("""SELECT printf('0x%08x', p_partkey * 16) AS address, p_name AS content, CAST(length(p_name) AS INTEGER) AS length FROM part WHERE p_partkey % 3 < 2 AND length(p_name) >= 2 AND p_partkey * 16 >= 4096""")
def defined_strings(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "TerminatedCString").when(F.col("p_partkey") % 3 == 1, "uchar[4]").otherwise("dword")
    return extract.defined_strings(fx.table(spark, sf_dir, "part").select((F.col("p_partkey") * 16).alias("offset"), kind.alias("data_type"), F.col("p_name").alias("value")))


@query("""SELECT printf('0x%08x', s_suppkey) AS address, s_name AS name, CAST(s_nationkey AS BIGINT) AS size FROM supplier""")
def extract_json_roundtrip(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "supplier").select(scalars.to_hex(F.col("s_suppkey")).alias("address"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("size"), F.concat(F.lit("p"), (F.col("s_suppkey") % 5).cast("string")).alias("program"))
    path = shared_path(spark, "extract")
    extract.write_extract({"functions": rows}, path)
    return extract.read_extract(spark, path)["functions"].select("address", "name", "size")


@query("""WITH s AS (SELECT p_partkey * 16 AS a, p_partkey % 10 = 0 AS bad, p_partkey * 16 < 320 AS below FROM part), u AS (SELECT a FROM s WHERE NOT bad AND NOT below),
r AS (SELECT l_partkey * 32 AS t, l_orderkey AS f FROM lineitem), m AS (SELECT f FROM u JOIN r ON a = t), h AS (SELECT f FROM m JOIN supplier ON f BETWEEN s_suppkey * 500 AND s_suppkey * 500 + 199)
SELECT (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM s WHERE below) AS skipped_below_base, (SELECT count(*) FROM s WHERE bad AND NOT below) AS addr_convert_fail, (SELECT count(*) FROM u WHERE a NOT IN (SELECT t FROM r)) AS no_refs,
  (SELECT count(*) FROM m) AS refs_found, (SELECT count(*) FROM m) - (SELECT count(*) FROM h) AS no_containing_func, (SELECT count(*) FROM h) AS added""")
def xref_diagnostics(spark, sf_dir):
    at = F.col("p_partkey") * 16
    strings = fx.table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 == 0, "none").otherwise(scalars.to_hex(at)).alias("address"), F.when((F.col("p_partkey") % 10 != 0) | (at < 320), at).alias("addr_offset"))
    refs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_addr"), (F.col("l_partkey") * 32).alias("to_addr"))
    ranges = fx.table(spark, sf_dir, "supplier").select(scalars.to_hex(F.col("s_suppkey") * 500).alias("address"), (F.col("s_suppkey") * 500).alias("lo"), (F.col("s_suppkey") * 500 + 199).alias("hi"))
    return extract.string_refs(strings, refs, ranges, 320)[1]


# Features


@query(f"""WITH {LINES}, {IDF} SELECT idf.s, count(*) AS df, round(idf.idf, 6) AS idf FROM b JOIN idf USING (s) GROUP BY idf.s, idf.idf""")
def doc_freq_idf(spark, sf_dir):
    bins, _ = fx.by_lines(spark, sf_dir)
    return features.document_frequency(bins).join(features.idf(bins), "s").select("s", "df", r6("idf"))


@query(f"""WITH {LINES} SELECT s, min(func_id) AS func_id FROM b GROUP BY s HAVING count(DISTINCT func_id) = 1""")
def unique_strings(spark, sf_dir):
    return features.unique_strings(fx.by_lines(spark, sf_dir)[0])


@query("""SELECT DISTINCT l_orderkey AS func_id, p_brand AS s FROM lineitem JOIN part ON l_partkey = p_partkey""")
def indirect_strings(spark, sf_dir):
    return features.indirect_strings(*fx.order_brands(spark, sf_dir))


@query("""SELECT DISTINCT o_custkey AS func_id, p_type AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")
def caller_attributed_strings(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    mapping = lines.select(F.col("l_orderkey").alias("function_id"), F.col("l_partkey").alias("string_id"))
    functions = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("is_def"))
    calls = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caller_id"), F.col("o_orderkey").alias("callee_id"))
    strings = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("content"))
    return features.caller_strings(mapping, strings, functions, calls)


@query("""SELECT DISTINCT l_orderkey AS func_id, p_name AS s FROM lineitem JOIN part ON l_partkey = p_partkey""")
def function_strings(spark, sf_dir):
    mapping = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("func_id"), F.col("l_partkey").alias("string_id"))
    return features.function_strings(mapping, fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content")))


_REF_TYPE = "CASE WHEN l_returnflag = 'R' THEN 'direct' ELSE l_returnflag END"


@query(f"""SELECT l_orderkey, l_linenumber, ref_type, kind FROM (SELECT *, {_REF_TYPE} AS ref_type FROM lineitem), (SELECT unnest(['filter', 'fallback']) AS kind) WHERE ref_type = 'direct' AND kind = 'filter' OR ref_type <> 'direct' AND kind = 'fallback'""")
def direct_ref_filter(spark, sf_dir):
    refs = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_REF_TYPE).alias("ref_type"))
    kinds = {"filter": refs, "fallback": refs.where("ref_type <> 'direct'")}  # the second has no direct one
    one, two = (features.direct_refs(df).withColumn("kind", F.lit(k)) for k, df in kinds.items())
    return one.unionByName(two)


_CHILD = "strings AS (SELECT p_partkey AS id, p_name AS content FROM part), refs AS (SELECT l_orderkey AS func_id, l_partkey AS string_id, CASE WHEN l_returnflag = 'R' THEN 'direct' ELSE 'indirect' END AS ref_type FROM lineitem)"


@query(f"""WITH {_CHILD} SELECT DISTINCT 'v3' AS mode, func_id, content AS s FROM refs JOIN strings ON id = string_id WHERE ref_type = 'direct' UNION ALL SELECT DISTINCT 'v2', func_id, content FROM refs JOIN strings ON id = string_id
UNION ALL SELECT DISTINCT 'old', func_id, content FROM refs JOIN strings ON id = string_id WHERE ref_type <> 'direct'""")
def loaded_binary_strings(spark, sf_dir):
    strings = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"))
    refs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("func_id"), F.col("l_partkey").alias("string_id"), F.when(F.col("l_returnflag") == "R", "direct").otherwise("indirect").alias("ref_type"))
    each = {"v3": relations.binary_strings(refs, strings, "v3"), "v2": relations.binary_strings(refs, strings, "v2"), "old": relations.binary_strings(refs.where("ref_type <> 'direct'"), strings, "v3")}
    out = None
    for name, df in each.items():
        df = df.select(F.lit(name).alias("mode"), "func_id", "s")
        out = df if out is None else out.unionByName(df)
    return out


@query("""SELECT p_partkey AS src_id, p_name AS name, CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey % 50 END AS BIGINT) AS size, p_brand AS file_path FROM part""")
def function_info(spark, sf_dir):
    last = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") + F.col("p_partkey") % 50)
    rows = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line_start"), last.alias("line_end"))
    return relations.function_info(rows)


@query("""SELECT s_suppkey AS bin_id, s_name AS name, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey END AS BIGINT) AS size, printf('0x%08x', s_suppkey) AS address FROM supplier WHERE s_suppkey % 3 <> 0""")
def non_library(spark, sf_dir):
    size = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey"))
    rows = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), size.alias("size"), scalars.to_hex(F.col("s_suppkey")).alias("address"), (F.col("s_suppkey") % 3 == 0).cast("int").alias("is_library"))
    return relations.non_library(rows)


@query(f"""WITH {GRAPH} SELECT id AS func_id, CAST(sum(i) AS BIGINT) AS callers, CAST(sum(o) AS BIGINT) AS callees FROM (SELECT caller_id AS id, 0 AS i, 1 AS o FROM be UNION ALL SELECT callee_id, 1, 0 FROM be) GROUP BY id""")
def degree_summary(spark, sf_dir):
    return features.degrees(fx.graph(spark, sf_dir)[0])


_MOST = "SELECT p_partkey AS id, p_name AS name, count(*) AS call_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY call_count DESC, id LIMIT 10"


@query(_MOST)
def most_called(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return features.most_called(part, fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("callee_id")))


@query("SELECT s_suppkey AS id, s_name AS name, count(*) AS call_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY call_count DESC, id LIMIT 10")
def most_calling(spark, sf_dir):
    supplier = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return features.most_calling(supplier, fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller_id")))


# Matching by strings


@query(f"""WITH {SENTENCES}, {EVIDENCE} SELECT * FROM ev""")
def evidence_pairs(spark, sf_dir):
    return assign.evidence_pairs(*fx.by_sentences(spark, sf_dir))


@query(f"""WITH {SENTENCES}, {EVIDENCE} SELECT bin_id, min(s) AS s, arg_min(src_id, s) AS src_id FROM ub JOIN uc USING (s) GROUP BY bin_id""")
def first_wins_unique(spark, sf_dir):
    return assign.first_wins(*fx.by_sentences(spark, sf_dir))


@query(f"""WITH {SENTENCES}, {EVIDENCE}, {greedy_sql("ev", "evidence", 6)} SELECT bin_id, src_id, evidence FROM matched JOIN ev USING (bin_id, src_id)""")
def greedy_bijective(spark, sf_dir):
    return assign.assign(assign.evidence_pairs(*fx.by_sentences(spark, sf_dir)), "evidence")[0]


@query(f"""WITH {SENTENCES}, {EVIDENCE}, {greedy_sql("ev", "evidence", 6)} SELECT bin_id, src_id, round(0.95 * (1 - 1.0 / (evidence + 1)), 6) AS score, 'unique_string_direct_conflict' AS method FROM ev WHERE (bin_id, src_id) NOT IN (SELECT (bin_id, src_id) FROM matched)""")
def conflict_candidates(spark, sf_dir):
    lost = assign.assign(assign.evidence_pairs(*fx.by_sentences(spark, sf_dir)), "evidence")[1]
    return lost.select("bin_id", "src_id", F.round(0.95 * (1 - 1 / (F.col("evidence") + 1)), 6).alias("score"), F.lit("unique_string_direct_conflict").alias("method"))


@query(f"""WITH {LINES}, {IDF} SELECT bin_id, src_id, shared, round(jaccard, 6) AS jaccard FROM sim""")
def jaccard_pairs(spark, sf_dir):
    return similarity.similarity(*fx.by_lines(spark, sf_dir)).select("bin_id", "src_id", "shared", r6("jaccard"))


@query(f"""WITH {LINES}, {IDF} SELECT bin_id, src_id, round(weighted, 6) AS weighted FROM sim""")
def weighted_jaccard(spark, sf_dir):
    return similarity.shared_sets(*fx.by_lines(spark, sf_dir)).valued(weighted=r6("weighted"))


@query(f"""WITH {LINES}, {IDF} SELECT bin_id, src_id, round(0.35 * jaccard + 0.65 * weighted, 6) AS score FROM sim WHERE round(0.35 * jaccard + 0.65 * weighted, 12) > 0.25""")
def combined_score_candidates(spark, sf_dir):
    return similarity.combined_candidates(*fx.by_lines(spark, sf_dir), 0.25).select("bin_id", "src_id", r6("score"))


_RANKED = "(SELECT bin_id, src_id, sc, row_number() OVER w AS r, lead(sc) OVER w AS nx FROM (SELECT bin_id, src_id, 0.35 * jaccard + 0.65 * weighted AS sc FROM sim) WHERE round(sc, 12) > 0.25 WINDOW w AS (PARTITION BY bin_id ORDER BY round(sc, 12) DESC, src_id))"


@query(f"""WITH {LINES}, {IDF} SELECT bin_id, src_id, round(sc, 6) AS score FROM {_RANKED} WHERE r = 1 AND round(sc, 12) > 0.75 AND (nx IS NULL OR round(sc - nx, 12) > 0.15)""")
def top1_gap_confirm(spark, sf_dir):
    return similarity.combined_best(*fx.by_lines(spark, sf_dir), 0.25, 0.75, 0.15).select("bin_id", "src_id", r6("score"))


@query(f"""WITH {LINES}, {IDF} SELECT bin_id, src_id, round(weighted, 6) AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY round(weighted, 12) DESC, src_id) AS r FROM sim WHERE round(weighted, 12) >= 0.6) WHERE r = 1""")
def argmax_similarity(spark, sf_dir):
    return assign.best_per_bin(similarity.similar_pairs(*fx.by_lines(spark, sf_dir), 0.6), "weighted").select("bin_id", "src_id", r6("weighted"))


@query(f"""WITH {LINES}, {IDF} SELECT bin_id, src_id, round(weighted, 6) AS weighted FROM sim WHERE round(weighted, 12) >= 0.6""")
def threshold_all_pairs(spark, sf_dir):
    return similarity.similar_pairs(*fx.by_lines(spark, sf_dir), 0.6).select("bin_id", "src_id", r6("weighted"))


@query(f"""WITH {LINES}, {IDF}, p AS (SELECT bin_id, src_id, round(weighted, 12) AS wt FROM sim WHERE round(weighted, 12) >= 0.6), {greedy_sql("p", "wt", 12)} SELECT bin_id, src_id, round(wt * 0.85, 6) AS confidence FROM matched JOIN p USING (bin_id, src_id)""")
def similarity_bijective(spark, sf_dir):
    pairs = similarity.similar_pairs(*fx.by_lines(spark, sf_dir), 0.6).withColumn("weighted", F.round("weighted", 12))
    return assign.assign(pairs, "weighted")[0].select("bin_id", "src_id", F.round(F.col("weighted") * 0.85, 6).alias("confidence"))


# Matching by calls


def _unseeded(spark, sf_dir):
    bins, src, seeds = fx.graph(spark, sf_dir)
    nodes = bins.select(F.col("caller_id").alias("bin_id")).unionByName(bins.select(F.col("callee_id").alias("bin_id"))).distinct()
    return bins, src, seeds, nodes.where("bin_id % 10 = 0").select("bin_id", F.col("bin_id").alias("src_id"))


def _calls(spark, sf_dir):
    bins, src, seeds, pairs = _unseeded(spark, sf_dir)
    return similarity.call_similarity(pairs, bins, src, seeds)


@query(f"""WITH {GRAPH}, {UNSEEDED}, {CALL} SELECT bin_id, src_id, round(call, 6) AS call FROM calls""")
def call_similarity(spark, sf_dir):
    return _calls(spark, sf_dir).select("bin_id", "src_id", r6("call"))


_TWO_HOPS = """ub AS (SELECT caller_id AS x, callee_id AS y FROM be UNION SELECT callee_id, caller_id FROM be), us AS (SELECT caller_id AS x, callee_id AS y FROM se UNION SELECT callee_id, caller_id FROM se),
pairs AS (SELECT DISTINCT ub.x AS bin_id, us.y AS src_id FROM ub JOIN seeds ON seeds.bin_id = ub.y JOIN us ON us.x = seeds.src_id WHERE ub.x % 10 = 0)"""


@query(f"""WITH {GRAPH}, {_TWO_HOPS}, {CALL} SELECT bin_id, src_id, round(call * 0.8, 6) AS score FROM calls WHERE round(call, 12) > 0.3""")
def neighbor_inference(spark, sf_dir):
    bins, src, seeds, opened = _unseeded(spark, sf_dir)
    found = similarity.inferred_pairs(opened.select("bin_id"), bins, src, seeds, 0.3)
    return found.select("bin_id", "src_id", F.round(F.col("call") * 0.8, 6).alias("score"))


_BOOST = f"""WITH {GRAPH}, cand AS (SELECT id AS bin_id, id AS src_id FROM nodes WHERE id % 20 = 0), {_TWO_HOPS.replace("pairs AS", "two AS").replace("ub.x % 10 = 0", "ub.x % 20 = 10")}, pairs AS (SELECT * FROM cand UNION ALL SELECT * FROM two), {CALL},
boosted AS (SELECT bin_id, src_id, CASE WHEN round(call, 12) > 0.1 THEN 0.9 * 0.6 + call * 0.4 ELSE 0.9 END AS score, CASE WHEN round(call, 12) > 0.1 THEN 'string+callgraph' ELSE 'c' END AS method FROM calls JOIN cand USING (bin_id, src_id)
  UNION ALL SELECT bin_id, src_id, call * 0.8, 'callgraph' FROM calls JOIN two USING (bin_id, src_id) WHERE round(call, 12) > 0.3)"""


def _call_phase(spark, sf_dir) -> State:
    """Phase 3 alone: half of the open nodes have themselves as a candidate, the others have none."""
    bins, src, seeds, opened = _unseeded(spark, sf_dir)
    state = State.empty(spark).confirm(seeds.select("bin_id", "src_id", F.lit(1.0).alias("confidence"), F.lit("seed").alias("method")), 0)
    mine = opened.where("bin_id % 20 = 0").select("bin_id", "src_id", F.lit(0.9).alias("score"), F.lit("c").alias("method"), F.col("src_id").alias("order"))
    nodes = seeds.select("bin_id").unionByName(opened.select("bin_id"))
    src_nodes = src.select(F.col("caller_id").alias("src_id")).unionByName(src.select(F.col("callee_id").alias("src_id"))).distinct()
    return v2.call_graph(_GraphInputs(nodes, src_nodes, bins, src), state.propose(mine, 2).settled())


@query(f"""{_BOOST} SELECT bin_id, src_id, round(score, 6) AS score, method FROM boosted""")
def callgraph_boost(spark, sf_dir):
    return _call_phase(spark, sf_dir).candidates.select("bin_id", "src_id", r6("score"), "method")


@query(f"""{_BOOST} SELECT bin_id, src_id, round(score, 6) AS confidence, method FROM (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY round(score, 12) DESC, src_id) AS r FROM boosted) WHERE r = 1 AND round(score, 12) > 0.7""")
def callgraph_confirmed(spark, sf_dir):
    return _call_phase(spark, sf_dir).confirmed.where("method <> 'seed'").select("bin_id", "src_id", r6("confidence"), "method")


@query("""SELECT p_partkey, round(CASE WHEN p_size > 10 AND p_partkey % 60 > 0 THEN least(p_size, p_partkey % 60) / CAST(greatest(p_size, p_partkey % 60) AS DOUBLE) WHEN p_size > 0 AND p_size <= 10 AND p_partkey % 60 > 0 THEN 0.5 ELSE 0.5 END, 6) AS size_sim FROM part""")
def size_similarity(spark, sf_dir):
    one = F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0)
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.size_similarity(one, F.col("p_partkey") % 60), 6).alias("size_sim"))


@query(f"""WITH {LINES}, {IDF} SELECT bin_id, src_id, round(0.5 * (0.4 * jaccard + 0.6 * weighted) + 0.15 * CASE WHEN x.n_chars > 0 AND y.n_chars > 0 THEN least(x.n_chars, y.n_chars) / CAST(greatest(x.n_chars, y.n_chars) AS DOUBLE) ELSE 0.5 END, 6) AS score
FROM sim JOIN documents x ON x.doc_id = bin_id JOIN documents y ON y.doc_id = src_id""")
def hybrid_score(spark, sf_dir):
    size = lambda c: fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("func_id"), F.col("n_chars").alias(c))
    sized = similarity.similarity(*fx.by_lines(spark, sf_dir), bin_info=size("x"), src_info=size("y"))
    score = similarity.hybrid(similarity.string_score(F.col("jaccard"), F.col("weighted")), F.lit(0.0), scalars.size_similarity(F.col("x"), F.col("y")))
    return sized.select("bin_id", "src_id", F.round(score, 6).alias("score"))


_PROP = """pb AS (SELECT pairs.bin_id, pairs.src_id, count(*) AS n, count(s.caller_id) AS h FROM pairs JOIN (SELECT DISTINCT callee_id, caller_id FROM be) e ON e.callee_id = pairs.bin_id JOIN seeds ON seeds.bin_id = e.caller_id LEFT JOIN se s ON s.callee_id = pairs.src_id AND s.caller_id = seeds.src_id GROUP BY 1, 2
UNION ALL SELECT pairs.bin_id, pairs.src_id, count(*), count(s.caller_id) FROM pairs JOIN (SELECT DISTINCT callee_id, caller_id FROM be) e ON e.caller_id = pairs.bin_id JOIN seeds ON seeds.bin_id = e.callee_id LEFT JOIN se s ON s.caller_id = pairs.src_id AND s.callee_id = seeds.src_id GROUP BY 1, 2),
bonus AS (SELECT bin_id, src_id, 0.2 * sum(h) / CAST(sum(n) AS DOUBLE) AS bonus FROM pb GROUP BY 1, 2)"""
_NEAR_PAIRS = "pairs AS (SELECT id AS bin_id, id + d AS src_id FROM nodes, (SELECT unnest([0, 1]) AS d) WHERE id % 10 = 0)"


def _near(spark, sf_dir):
    bins, src, seeds, pairs = _unseeded(spark, sf_dir)
    return bins, src, seeds, pairs.unionByName(pairs.select("bin_id", (F.col("src_id") + 1).alias("src_id")))


@query(f"""WITH {GRAPH}, {_NEAR_PAIRS}, {_PROP} SELECT bin_id, src_id, round(least(0.5 + coalesce(bonus, 0), 0.98), 6) AS score FROM pairs LEFT JOIN bonus USING (bin_id, src_id)""")
def propagation_round(spark, sf_dir):
    bins, src, seeds, pairs = _near(spark, sf_dir)
    rows = similarity.propagation_bonus(pairs, bins, src, seeds)
    return rows.select("bin_id", "src_id", F.round(F.least(0.5 + F.col("bonus"), F.lit(0.98)), 6).alias("score"))


def _fixpoint_sql(rounds: int) -> str:
    """Unrolled rounds: c_k candidates, f_k mapping."""
    out = [GRAPH, _NEAR_PAIRS, "c0 AS (SELECT bin_id, src_id, 0.5 AS sc FROM pairs)", "f0 AS (SELECT * FROM seeds)"]
    for k in range(1, rounds + 1):
        sub = _PROP.replace("pairs", f"o{k}").replace("JOIN seeds", f"JOIN f{k - 1}").replace("seeds.", f"f{k - 1}.").replace("pb AS", f"pb{k} AS").replace("bonus AS (", f"bonus{k} AS (").replace("FROM pb ", f"FROM pb{k} ")
        out.append(f"o{k} AS (SELECT * FROM c{k - 1} WHERE bin_id NOT IN (SELECT bin_id FROM f{k - 1}))")
        out.append(sub)
        out.append(f"c{k} AS (SELECT bin_id, src_id, least(sc + coalesce(bonus, 0), 0.98) AS sc FROM o{k} LEFT JOIN bonus{k} USING (bin_id, src_id))")
        out.append(f"n{k} AS (SELECT bin_id, src_id, sc FROM (SELECT *, row_number() OVER w AS r, lead(sc) OVER w AS nx FROM c{k} WINDOW w AS (PARTITION BY bin_id ORDER BY round(sc, 12) DESC, src_id)) WHERE r = 1 AND round(sc, 12) > 0.68 AND (nx IS NULL OR round(sc - nx, 12) > 0.12))")
        out.append(f"f{k} AS (SELECT * FROM f{k - 1} UNION ALL SELECT bin_id, src_id FROM n{k})")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT bin_id, src_id, round(sc, 6) AS confidence FROM n{k}" for k in range(1, rounds + 1))


@query(_fixpoint_sql(5))
def propagation_fixpoint(spark, sf_dir):
    bins, src, seeds, pairs = _near(spark, sf_dir)
    state = State.empty(spark).confirm(seeds.select("bin_id", "src_id", F.lit(1.0).alias("confidence"), F.lit("seed").alias("method")), 0)
    state = state.propose(pairs.select("bin_id", "src_id", F.lit(0.5).alias("score"), F.lit("c").alias("method"), F.col("src_id").alias("order")), 1).settled()
    inputs = _GraphInputs(pairs.select("bin_id").distinct(), pairs.select("src_id").distinct(), bins, src)
    return v2.propagation(inputs, state).confirmed.where("method <> 'seed'").select("bin_id", "src_id", F.round("confidence", 6).alias("confidence"))


class _GraphInputs:
    """Inputs of the phases that look at calls alone."""

    def __init__(self, bin_info: DataFrame, src_info: DataFrame, bin_edges: DataFrame, src_edges: DataFrame):
        self.bin_info, self.src_info, self.bin_edges, self.src_edges = bin_info, src_info, bin_edges, src_edges


# Reports


@query(f"""WITH {RESULTS} SELECT CASE WHEN confidence > 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS level, count(*) AS count FROM res GROUP BY 1""")
def confidence_buckets(spark, sf_dir):
    return report.buckets(_by_class(spark, sf_dir)[1], "copies")


@query(f"""WITH {RESULTS} SELECT method, count(*) AS count, round(avg(confidence), 6) AS avg_confidence FROM res GROUP BY 1""")
def method_histogram(spark, sf_dir):
    return report.methods(_by_class(spark, sf_dir)[1], "copies").select("method", "count", r6("avg_confidence"))


@query(f"""WITH {RESULTS} SELECT count(*) AS total, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM res""")
def overall_stats(spark, sf_dir):
    return report.overall(_by_class(spark, sf_dir)[1], "copies").select("total", r6("avg_confidence"), "min_confidence", "max_confidence")


@query(f"""WITH {RESULTS} SELECT bin_func_id, src_func_id, confidence FROM res WHERE confidence >= 0.3 ORDER BY confidence DESC, bin_func_id, src_func_id LIMIT 20""")
def top_matches(spark, sf_dir):
    shared, classes = _by_class(spark, sf_dir)
    return report.top(_expanded(shared.best(classes, 20, "confidence")), 20, 0.3).select("bin_func_id", "src_func_id", "confidence")


@query(f"""WITH {RESULTS} SELECT bin_func_id, src_func_id, src_func_name, confidence AS score FROM res ORDER BY score DESC, bin_func_id, src_func_id LIMIT 10""")
def top_candidates(spark, sf_dir):
    shared, classes = _by_class(spark, sf_dir)
    rows = cut(_expanded(shared.best(classes, 10, "confidence")))
    names = rows.select("src_func_id", "src_func_name").distinct()
    return report.top_candidates(rows.select("bin_func_id", "src_func_id", F.col("confidence").alias("score")), names).select("bin_func_id", "src_func_id", "src_func_name", "score")


@query(f"""WITH {RESULTS} SELECT bin_func_id, src_func_id, confidence AS score FROM (SELECT *, row_number() OVER (PARTITION BY bin_func_id ORDER BY confidence DESC, src_func_id) AS r FROM res) WHERE r <= 5""")
def top5_per_bin(spark, sf_dir):
    shared, classes = _by_class(spark, sf_dir)
    # A class of source functions is named by its smallest, so the five first classes have the five first functions.
    first = assign.top_per_bin(classes.select(F.col("bin_class").alias("bin_id"), "src_class", F.col("confidence").alias("score")), 5, F.desc("score"), "src_class")
    rows = shared.expanded(first.withColumnRenamed("bin_id", "bin_class"), 5).select("bin_id", "src_id", "score")
    return assign.top_per_bin(rows, 5, F.desc("score"), "src_id").select(F.col("bin_id").alias("bin_func_id"), F.col("src_id").alias("src_func_id"), "score")


@query("""SELECT CAST(func AS BIGINT) AS bin_id, name AS src_name, shared_strings FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY shared_strings DESC, func) AS r FROM (SELECT doc_id AS func, source AS name, n_chars % 50 AS shared_strings FROM documents)) WHERE r = 1""")
def name_dedup_export(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("bin_id"), F.col("source").alias("src_name"), (F.col("n_chars") % 50).alias("shared_strings"), F.lit(0).alias("seq"))
    return assign.one_per_name(rows).select("bin_id", "src_name", "shared_strings")


@query(f"""WITH {RESULTS} SELECT bin_func_id, src_func_id, src_func_name, confidence FROM res WHERE lower(src_func_name) LIKE '%c1__fn%'""")
def name_search(spark, sf_dir):
    return report.search(results(spark, sf_dir), "C1__FN").select("bin_func_id", "src_func_id", "src_func_name", "confidence")


@query(f"""WITH {RESULTS} SELECT '    (' || bin_address || ', "' || src_func_name || '"),  # ' || printf('%.3f', confidence) AS line FROM res WHERE confidence >= 0.7""")
def rename_script(spark, sf_dir):
    shared, classes = _by_class(spark, sf_dir)
    return report.rename_lines(_expanded(shared.expanded(classes.where(F.col("confidence") >= scalars.MEDIUM))))


@query(f"""WITH {RESULTS} SELECT count(*) AS matched, (SELECT count(*) FROM documents) AS total, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS match_percent FROM res""")
def run_summary(spark, sf_dir):
    return report.summary(_by_class(spark, sf_dir)[1], fx.table(spark, sf_dir, "documents"), "copies").select("matched", "total", r6("match_percent"))


@query(f"""WITH {SENTENCES}, {EVIDENCE}, {greedy_sql("ev", "evidence", 6)} SELECT 'phase1' AS phase, (SELECT count(*) FROM matched) AS confirmed_count, (SELECT count(*) FROM ev) - (SELECT count(*) FROM matched) AS candidate_count, CAST(0.95 AS DOUBLE) AS avg_confidence""")
def phase_statistics(spark, sf_dir):
    matches, lost = assign.assign(assign.evidence_pairs(*fx.by_sentences(spark, sf_dir)), "evidence")
    state = State.empty(spark).confirm(matches.select("bin_id", "src_id", F.lit(0.95).alias("confidence"), F.lit("u").alias("method")), 1)
    state = state.propose(lost.select("bin_id", "src_id", F.lit(0.0).alias("score"), F.lit("u").alias("method"), F.col("src_id").alias("order")), 1)
    return engine.statistics(state, "phase1").select("phase", "confirmed_count", "candidate_count", r6("avg_confidence"))


@query(f"""WITH {LINES}, m AS (SELECT bin_id, src_id FROM (SELECT x.func_id AS bin_id, y.func_id AS src_id FROM b x JOIN c y USING (s) GROUP BY 1, 2)) SELECT m.bin_id, m.src_id, CAST(count(*) AS INTEGER) AS shared_strings FROM m JOIN b ON b.func_id = m.bin_id JOIN c ON c.func_id = m.src_id AND c.s = b.s GROUP BY 1, 2""")
def export_shared_strings(spark, sf_dir):
    return similarity.similarity(*fx.by_lines(spark, sf_dir)).select("bin_id", "src_id", F.col("shared").cast("int").alias("shared_strings"))


def _pipeline(mode: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = fx.document_inputs(spark, sf_dir, keep=mode == "v3")
    state = engine.MatchEngine.of(mode).run(inputs)
    return engine.results(inputs, state, mode).drop("timestamp").withColumn("confidence", F.round("confidence", 6)).withColumn("call_similarity", F.round("call_similarity", 6))


_DOC_EDGES = "SELECT DISTINCT l_suppkey * 2 + {0} AS f, l_partkey * 2 + {0} AS g FROM lineitem WHERE l_suppkey <> l_partkey"


def _best_sql(source: str, least: float, gap: float | None) -> str:
    """The best candidate of each bin_id of source (bin_id, src_id, score, method, seq) above least, with a gap to the next."""
    apart = f"AND (nx IS NULL OR round(score - nx, 12) > {gap})" if gap is not None else ""
    return f"SELECT bin_id, src_id, score, method FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nx FROM {source} WINDOW w AS (PARTITION BY bin_id ORDER BY round(score, 12) DESC, seq, src_id)) WHERE r = 1 AND round(score, 12) > {least} {apart}"


def _v2_sql() -> str:
    """All phases of v2 over documents: k_n the candidates after a step, m_n the mapping, o_n the open candidates."""
    out = [
        f"{SENTENCES}, {EVIDENCE}, {IDF}",
        f"be AS (SELECT DISTINCT f AS caller_id, g AS callee_id FROM ({_DOC_EDGES.format(1)} AND l_orderkey % 10 <> 0)), se AS (SELECT DISTINCT f AS caller_id, g AS callee_id FROM ({_DOC_EDGES.format(0)}))",
        "info AS (SELECT doc_id, n_chars FROM documents)",
        "m1 AS (SELECT bin_id, arg_min(src_id, s) AS src_id, CAST(0.95 AS DOUBLE) AS score, 'unique_string' AS method FROM ub JOIN uc USING (s) GROUP BY bin_id)",
        "k2 AS (SELECT bin_id, src_id, 0.35 * jaccard + 0.65 * weighted AS score, 'string_set' AS method, 2 AS seq FROM sim WHERE round(0.35 * jaccard + 0.65 * weighted, 12) > 0.25 AND bin_id NOT IN (SELECT bin_id FROM m1))",
        f"m2 AS (SELECT * FROM m1 UNION ALL {_best_sql('k2', 0.75, 0.15)})",
        "o2 AS (SELECT * FROM k2 WHERE bin_id NOT IN (SELECT bin_id FROM m2))",
        call_sql("_o", pairs="o2", seeds="m2"),
        "lonely AS (SELECT doc_id AS bin_id FROM info WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT bin_id FROM m2) AND doc_id NOT IN (SELECT bin_id FROM k2))",
        "ube AS (SELECT caller_id AS x, callee_id AS y FROM be UNION SELECT callee_id, caller_id FROM be), use AS (SELECT caller_id AS x, callee_id AS y FROM se UNION SELECT callee_id, caller_id FROM se)",
        "two AS (SELECT DISTINCT l.bin_id, use.y AS src_id FROM lonely l JOIN ube ON ube.x = l.bin_id JOIN m2 ON m2.bin_id = ube.y JOIN use ON use.x = m2.src_id WHERE use.y IN (SELECT doc_id FROM info WHERE doc_id % 2 = 0))",
        call_sql("_l", pairs="two", seeds="m2"),
        "k3 AS (SELECT k2.bin_id, k2.src_id, CASE WHEN round(call, 12) > 0.1 THEN score * 0.6 + call * 0.4 ELSE score END AS score, CASE WHEN round(call, 12) > 0.1 THEN 'string+callgraph' ELSE method END AS method, seq FROM k2 LEFT JOIN calls_o USING (bin_id, src_id)"
        " UNION ALL SELECT bin_id, src_id, call * 0.8, 'callgraph', 3 FROM calls_l WHERE round(call, 12) > 0.3)",
        "o3 AS (SELECT * FROM k3 WHERE bin_id NOT IN (SELECT bin_id FROM m2))",
        f"m3 AS (SELECT * FROM m2 UNION ALL {_best_sql('o3', 0.70, None)})",
        "o4 AS (SELECT * FROM o3 WHERE bin_id NOT IN (SELECT bin_id FROM m3))",
        call_sql("_h", pairs="o4", seeds="m3"),
        "h4 AS (SELECT o4.bin_id, o4.src_id, 0.5 * coalesce(0.4 * jaccard + 0.6 * weighted, 0) + 0.35 * coalesce(call, 0) + 0.15 * CASE WHEN x.n_chars > 0 AND y.n_chars > 0 THEN least(x.n_chars, y.n_chars) / CAST(greatest(x.n_chars, y.n_chars) AS DOUBLE) ELSE 0.5 END AS score, 'hybrid' AS method, seq"
        " FROM o4 JOIN info y ON y.doc_id = o4.src_id LEFT JOIN info x ON x.doc_id = o4.bin_id LEFT JOIN sim ON sim.bin_id = o4.bin_id AND sim.src_id = o4.src_id LEFT JOIN calls_h ON calls_h.bin_id = o4.bin_id AND calls_h.src_id = o4.src_id)",
        f"nh AS ({_best_sql('h4', 0.70, 0.10)}), f0 AS (SELECT * FROM m3 UNION ALL SELECT * FROM nh), c0 AS (SELECT * FROM h4), n0 AS (SELECT 1 AS one)",
    ]
    for k in range(1, v2.ROUNDS + 1):
        sub = _PROP.replace("pairs", f"o5{k}").replace("JOIN seeds", f"JOIN f{k - 1}").replace("seeds.", f"f{k - 1}.").replace("pb AS", f"pb{k} AS").replace("bonus AS (", f"bonus{k} AS (").replace("FROM pb ", f"FROM pb{k} ")
        out.append(f"o5{k} AS (SELECT * FROM c{k - 1} WHERE bin_id NOT IN (SELECT bin_id FROM f{k - 1}))")
        out.append(sub)
        out.append(f"c{k} AS (SELECT o5{k}.bin_id, o5{k}.src_id, least(score + coalesce(bonus, 0), 0.98) AS score, method || '+propagation' AS method, seq FROM o5{k} LEFT JOIN bonus{k} USING (bin_id, src_id))")
        # A round after one that confirmed nothing doesn't take place.
        out.append(f"n{k} AS (SELECT * FROM ({_best_sql(f'c{k}', 0.68, 0.12)}) WHERE EXISTS (SELECT 1 FROM n{k - 1}))")
        out.append(f"f{k} AS (SELECT * FROM f{k - 1} UNION ALL SELECT * FROM n{k})")
    last = f"f{v2.ROUNDS}"
    out.append(call_sql("_z", pairs=last, seeds=last))
    return (
        "WITH " + ", ".join(out) + f" SELECT f.bin_id AS bin_func_id, printf('0x%08x', f.bin_id) AS bin_address, f.src_id AS src_func_id, y.source || '_' || f.src_id AS src_func_name, y.lang AS src_file_path, round(score, 6) AS confidence, method,"
        " CASE WHEN method LIKE '%indirect%' THEN 'indirect' ELSE 'direct' END AS ref_type, CAST(coalesce(shared, 0) AS INTEGER) AS shared_strings, round(coalesce(call, 0), 6) AS call_similarity"
        f" FROM {last} f JOIN documents x ON x.doc_id = f.bin_id JOIN documents y ON y.doc_id = f.src_id LEFT JOIN sim ON sim.bin_id = f.bin_id AND sim.src_id = f.src_id LEFT JOIN calls_z ON calls_z.bin_id = f.bin_id AND calls_z.src_id = f.src_id"
    )


@query(_v2_sql())
def v2_pipeline(spark, sf_dir):
    return _pipeline("v2", spark, sf_dir)


_V3 = f"""WITH {SENTENCES}, {EVIDENCE}, {greedy_sql("ev", "evidence", 6)},
bi AS (SELECT DISTINCT f AS func_id, s FROM ({_DOC_EDGES.format(1)} AND l_orderkey % 10 <> 0) JOIN b ON b.func_id = g), ci AS (SELECT DISTINCT f AS func_id, s FROM ({_DOC_EDGES.format(0)}) JOIN c ON c.func_id = g),
ev2_all AS (SELECT bin_id, src_id, count(*) AS evidence FROM (SELECT s, min(func_id) AS bin_id FROM bi GROUP BY s HAVING count(*) = 1) JOIN (SELECT s, min(func_id) AS src_id FROM ci GROUP BY s HAVING count(*) = 1) USING (s) GROUP BY 1, 2),
ev2 AS (SELECT * FROM ev2_all WHERE bin_id NOT IN (SELECT bin_id FROM matched) AND src_id NOT IN (SELECT src_id FROM matched)), {greedy_sql("ev2", "evidence", 8, "_2")},
done AS (SELECT * FROM matched UNION ALL SELECT * FROM matched_2),
nn AS (SELECT greatest(count(DISTINCT func_id), 1) AS n FROM b), idf AS (SELECT s, ln((n + 1.0) / (count(*) + 1.0)) AS idf FROM b, nn GROUP BY s, n),
bw AS (SELECT func_id, s, coalesce(idf, 1.0) AS w FROM bi LEFT JOIN idf USING (s) WHERE func_id NOT IN (SELECT bin_id FROM done)), cw AS (SELECT func_id, s, coalesce(idf, 1.0) AS w FROM ci LEFT JOIN idf USING (s) WHERE func_id NOT IN (SELECT src_id FROM done)),
sim AS (SELECT bin_id, src_id, round(w_i / nullif(w_a + w_b - w_i, 0), 12) AS wt FROM (SELECT bw.func_id AS bin_id, cw.func_id AS src_id, sum(bw.w) AS w_i FROM bw JOIN cw USING (s) GROUP BY 1, 2)
  JOIN (SELECT func_id AS bin_id, sum(w) AS w_a FROM bw GROUP BY 1) USING (bin_id) JOIN (SELECT func_id AS src_id, sum(w) AS w_b FROM cw GROUP BY 1) USING (src_id)),
near AS (SELECT * FROM sim WHERE wt >= 0.6), {greedy_sql("near", "wt", 14, "_3")},
conf AS (SELECT bin_id, src_id, CAST(0.95 AS DOUBLE) AS confidence, 'unique_string_direct' AS method FROM matched UNION ALL SELECT bin_id, src_id, 0.8, 'unique_string_indirect' FROM matched_2
  UNION ALL SELECT bin_id, src_id, wt * 0.85, 'indirect_multi_string' FROM matched_3 JOIN near USING (bin_id, src_id))
SELECT bin_id AS bin_func_id, printf('0x%08x', bin_id) AS bin_address, src_id AS src_func_id, y.source || '_' || src_id AS src_func_name, y.lang AS src_file_path, round(confidence, 6) AS confidence, method,
  CASE WHEN method LIKE '%indirect%' THEN 'indirect' ELSE 'direct' END AS ref_type, CAST((SELECT count(*) FROM b JOIN c USING (s) WHERE b.func_id = bin_id AND c.func_id = src_id) AS INTEGER) AS shared_strings, CAST(0 AS DOUBLE) AS call_similarity
FROM conf JOIN documents x ON x.doc_id = bin_id JOIN documents y ON y.doc_id = src_id"""


@query(_V3)
def v3_pipeline(spark, sf_dir):
    return _pipeline("v3", spark, sf_dir)


@query(f"""WITH {LINES}, {IDF}, near AS (SELECT bin_id, src_id, round(weighted, 12) AS wt FROM sim WHERE round(weighted, 12) >= 0.6), {greedy_sql("near", "wt", 12)}
SELECT bin_id, src_id, round(CASE WHEN m THEN wt * 0.85 ELSE wt * 0.85 * 0.9 END, 6) AS score, CASE WHEN m THEN 'indirect_multi_string' ELSE 'indirect_multi_string_conflict' END AS method FROM (SELECT *, (bin_id, src_id) IN (SELECT (bin_id, src_id) FROM matched) AS m FROM near)""")
def indirect_similarity_phase(spark, sf_dir):
    """Matches and conflicts of v3's second phase alone, lines standing for indirect strings."""
    bins, srcs = fx.by_lines(spark, sf_dir)
    none = spark.createDataFrame([], "caller_id long, callee_id long")
    state = v3.indirect_similarity(Inputs(None, None, bins, srcs, none, none, bins, srcs, features.idf(bins)), State.empty(spark))
    return state.confirmed.select("bin_id", "src_id", F.round("confidence", 6).alias("score"), "method").unionByName(state.candidates.select("bin_id", "src_id", r6("score"), "method"))


@query(f"""WITH {SENTENCES}, {EVIDENCE} SELECT 'phase1' AS phase, bin_id AS bin_func_id, arg_min(src_id, s) AS src_func_id, CAST(0.95 AS DOUBLE) AS score, 'unique_string: "' || left(min(s), 60) || '"' AS reason FROM ub JOIN uc USING (s) GROUP BY bin_id""")
def phase_log(spark, sf_dir):
    bins, srcs = fx.by_sentences(spark, sf_dir)
    none = spark.createDataFrame([], "caller_id long, callee_id long")
    state = v2.unique_string(Inputs(None, None, bins, srcs, none, none, None, None, None), State.empty(spark))
    return engine.match_log(state).drop("timestamp")


@query(f"""WITH {SENTENCES}, {EVIDENCE}, {greedy_sql("ev", "evidence", 6)} SELECT bin_id, src_id, CAST(0.95 AS DOUBLE) AS confidence, 'unique_string_direct' AS method FROM matched""")
def resumed_matches(spark, sf_dir):
    """Phase 1 exported, and read back as the state that a later run starts from."""
    inputs = fx.document_inputs(spark, sf_dir)
    state = v3.first_round(inputs, State.empty(spark))
    path = shared_path(spark, "results")
    engine.results(inputs, state, "v3").write.parquet(f"{path}/mapping_results")
    return engine.resume(spark, path).confirmed.drop("seq")


def _statistics_sql() -> str:
    head = _V3[: _V3.index("conf AS (")].rstrip().rstrip(",")
    return f"""{head}, p1 AS (SELECT (SELECT count(*) FROM done) AS c, (SELECT count(*) FROM ev) - (SELECT count(*) FROM matched) + (SELECT count(*) FROM ev2_all) - (SELECT count(*) FROM matched_2) AS k, (SELECT count(*) FROM matched) * 0.95 + (SELECT count(*) FROM matched_2) * 0.8 AS s),
p2 AS (SELECT (SELECT count(*) FROM matched_3) AS c, (SELECT count(*) FROM near) - (SELECT count(*) FROM matched_3) AS k, (SELECT coalesce(sum(wt * 0.85), 0) FROM matched_3 JOIN near USING (bin_id, src_id)) AS s)
SELECT 'phase1' AS phase, c AS confirmed_count, k AS candidate_count, round(CAST(s / c AS DOUBLE), 6) AS avg_confidence FROM p1 UNION ALL SELECT 'phase2', p1.c + p2.c, p1.k + p2.k, round(CAST((p1.s + p2.s) / (p1.c + p2.c) AS DOUBLE), 6) FROM p1, p2"""


@query(_statistics_sql())
def statistics_by_phase(spark, sf_dir):
    run = engine.MatchEngine.of("v3")
    run.run(fx.document_inputs(spark, sf_dir))
    return run.statistics().select("phase", "confirmed_count", "candidate_count", r6("avg_confidence"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique-string evidence, assigned one to one, as mapping_results rows."""
    inputs = fx.document_inputs(spark, sf_dir)
    state = v3.first_round(inputs, State.empty(spark))
    return engine.results(inputs, state, "v3").drop("timestamp")

