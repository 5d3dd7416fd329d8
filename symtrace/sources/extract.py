"""Binary extracts: the JSON document, raw string runs, priority merges, address joins and the as-of join of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symtrace import schemas
from symtrace.functions import scalars

TOLERANCE = 64


def read_extract(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """functions, strings, call_graph, func_string_refs of extract documents; missing keys are empty."""
    doc = spark.read.schema(schemas.EXTRACT).option("multiLine", True).json(path)
    return {name: doc.select(F.inline(F.coalesce(F.col(name), F.array().cast(doc.schema[name].dataType)))) for name in ("functions", "strings", "call_graph", "func_string_refs")}


#: Rows of one table that a document may have: a document is one value, in one task.
MOST_ROWS = 5_000_000


def write_extract(tables: dict[str, DataFrame], path: str, program: str = "", image_base: str = "") -> None:
    """One JSON document for each program: tables may have a column program; without one their rows are of `program`. A
    program with more than MOST_ROWS rows in a table is refused, as its document would be too large for a task."""
    spark = next(iter(tables.values())).sparkSession
    docs = spark.createDataFrame([(program,)], "program string") if any("program" not in df.columns for df in tables.values()) else None
    lists = []
    for name, df in tables.items():
        df = df if "program" in df.columns else df.withColumn("program", F.lit(program))
        large = df.groupBy("program").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS).limit(1).collect()
        if large:
            raise ValueError(f"{name} of program {large[0]['program']!r} has {large[0]['n']} rows; write Parquet relations instead")
        lists.append(df.groupBy("program").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "program"]))).alias(name)))
        docs = df.select("program").distinct() if docs is None else docs.unionByName(df.select("program")).distinct()
    for one in lists:
        docs = docs.join(one, "program", "left")
    docs = docs.withColumn("image_base", F.lit(image_base)).select("program", "image_base", *tables)
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)  # a file holds one document


def raw_strings(blocks: DataFrame, least: int = 5) -> DataFrame:
    """address, content, length of the runs of printable bytes in memory blocks (start LONG, data BINARY). The length is
    that before stripping. Offsets come from the lengths of what stands before a run."""
    text = F.decode("data", "ISO-8859-1")
    run = r"[\x20-\x7E\t\n\r]{" + str(least) + ",}"
    marked = F.regexp_replace(text, "(" + run + ")", "Ā$1Ā")
    parts = blocks.select("start", F.posexplode(F.split(marked, "Ā")).alias("pos", "part"))
    before = Window.partitionBy("start").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.withColumn("offset", F.col("start") + F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    return at.where(F.col("pos") % 2 == 1).select(scalars.to_hex(F.col("offset")).alias("address"), F.btrim("part", F.lit(" \t\n\r")).alias("content"), F.length("part").alias("length")).where("content <> ''")


def defined_strings(data: DataFrame) -> DataFrame:
    """address, content, length of defined data (offset LONG, data_type, value) that are strings: a type named after
    strings or characters, two characters or more, not in the lowest page."""
    kind = F.lower("data_type")
    rows = data.where((kind.contains("string") | kind.contains("char")) & (F.length("value") >= 2) & (F.col("offset") >= 0x1000))
    return rows.select(scalars.to_hex(F.col("offset")).alias("address"), F.col("value").alias("content"), F.length("value").alias("length"))


def priority_merge(first: DataFrame, second: DataFrame, key: str = "address") -> DataFrame:
    """Rows of both by key; on equal keys those of `first` win."""
    rows = first.withColumn("__prio", F.lit(0)).unionByName(second.withColumn("__prio", F.lit(1)))
    order = [F.col(c) for c in first.columns if c != key]
    w = Window.partitionBy(key).orderBy("__prio", *order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__prio", "__r")


def call_edges(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct calls: refs (func, target) whose target is a function's entry (functions: id, entry), not of itself."""
    return refs.join(functions.select(F.col("id").alias("callee"), F.col("entry").alias("target")), "target").where("func <> callee").select(F.col("func").alias("caller"), "callee").distinct()


def containing(refs: DataFrame, ranges: DataFrame, width: int = 1 << 12) -> DataFrame:
    """refs (addr, ...) with the id of the range (id, lo, hi inclusive) that holds addr; refs outside all are dropped.
    A range join by cells: a range is in every cell of `width` that it touches, an address in one."""
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return refs.withColumn("cell", F.floor(F.col("addr") / width)).join(cells, "cell").where("addr between lo and hi").drop("cell", "lo", "hi")


def string_refs(strings: DataFrame, refs: DataFrame, functions: DataFrame, image_base: int = 0) -> tuple[DataFrame, DataFrame]:
    """(func_addr, string_addr, ref_addr of the references to strings that lie in a function; one row of counters).
    strings: address, addr_offset; refs: from_addr, to_addr; functions: address, lo, hi. The counters: total strings,
    skipped_below_base, addr_convert_fail, no_refs, refs_found, no_containing_func, added."""
    offset = F.coalesce(scalars.from_hex(F.col("address")), F.col("addr_offset"))
    known = strings.select("address", F.col("addr_offset") < image_base, offset.alias("to_addr")).toDF("address", "below", "to_addr")
    known = known.withColumn("below", F.coalesce("below", F.lit(False)))
    usable = known.where("not below and to_addr is not null")
    met = usable.join(refs.select("from_addr", "to_addr"), "to_addr")
    found = containing(met.withColumnRenamed("from_addr", "addr"), functions.select(F.col("address").alias("id"), "lo", "hi"))
    rows = found.select(F.col("id").alias("func_addr"), F.col("address").alias("string_addr"), scalars.to_hex(F.col("addr")).alias("ref_addr"))
    one = known.agg(F.count("*").alias("total"), F.count_if(F.col("below")).alias("skipped_below_base"), F.count_if(~F.col("below") & F.col("to_addr").isNull()).alias("addr_convert_fail"))
    unmet = usable.join(refs.select("to_addr").distinct(), "to_addr", "left_anti").agg(F.count("*").alias("no_refs"))
    counted = met.agg(F.count("*").alias("refs_found")).crossJoin(rows.agg(F.count("*").alias("added")))  # one row each
    return rows, one.crossJoin(unmet).crossJoin(counted).withColumn("no_containing_func", F.col("refs_found") - F.col("added"))


def resolve(edges: DataFrame, ids: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(edges with the ids of their address columns, edges that name an address no row of ids (id, address) has)."""
    out = edges
    for c in columns:
        out = out.join(ids.select(F.col("address").alias(c), F.col("id").alias(f"{c}_id")), c, "left")
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(f"{c}_id").isNull()
    return out.where(~missing), out.where(missing).drop(*[f"{c}_id" for c in columns])


def next_call(refs: DataFrame, calls: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """As-of join, forward and strict: refs (func, addr, ...) with callee and call_addr of the first call (func, addr,
    callee, seq) after the address, if it is at most `tolerance` away. Only the nearest call counts.

    One shuffle by function and cell of addresses, so that a function with very many rows is many groups: a call is in its
    cell and, if references of the cell before can reach it, in that one. In a group rows are read once, from the highest
    address down, with the least call so far."""
    extra = [c for c in refs.columns if c not in ("func", "addr")]
    width = 64 * max(1, tolerance)
    cell = lambda a: F.floor(a / width)
    r = refs.select("func", "addr", cell(F.col("addr")).alias("cell"), F.lit(False).alias("is_call"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(calls.schema["callee"].dataType).alias("callee"), F.struct(*extra).alias("extra") if extra else F.lit(None).alias("extra"))
    cells = F.array_distinct(F.array(cell(F.col("addr")), cell(F.col("addr") - tolerance)))
    c = calls.select("func", "addr", F.explode(cells).alias("cell"), F.lit(True).alias("is_call"), F.col("seq").cast("long").alias("seq"), "callee", F.lit(None).cast(r.schema["extra"].dataType).alias("extra"))
    w = Window.partitionBy("func", "cell").orderBy(F.desc("addr")).rangeBetween(Window.unboundedPreceding, -1)
    found = F.min(F.when(F.col("is_call"), F.struct("addr", "seq", "callee"))).over(w)
    near = F.col("found.addr") - F.col("addr") <= tolerance
    out = r.unionByName(c).withColumn("found", found).where(~F.col("is_call"))
    return out.select("func", "addr", *([F.col(f"extra.{c}").alias(c) for c in extra] if extra else []), F.when(near, F.col("found.callee")).alias("callee"), F.when(near, F.col("found.addr")).alias("call_addr"))


def ref_fanout(refs: DataFrame) -> DataFrame:
    """refs (func, string, addr, callee): each as an indirect reference of its function and, where a call follows, a
    direct one of the callee. Distinct rows func_id, string_id, ref_addr, ref_type."""
    both = F.array(F.struct(F.col("func").alias("func_id"), F.lit("indirect").alias("ref_type")), F.when(F.col("callee").isNotNull(), F.struct(F.col("callee").alias("func_id"), F.lit("direct").alias("ref_type"))))
    return refs.select("string", "addr", F.explode(F.array_compact(both)).alias("x")).select("x.func_id", F.col("string").alias("string_id"), F.col("addr").alias("ref_addr"), "x.ref_type").distinct()


def import_extract(tables: dict[str, DataFrame], tolerance: int = TOLERANCE) -> dict[str, DataFrame]:
    """The relations binary_functions, binary_strings, binary_call_graph, binary_func_string_refs and `skipped`, the counts
    of edges and references that name unknown addresses. Ids are dense, by address."""
    from . import store

    functions = store.numbered(store.insert_or_ignore(tables["functions"].where("address is not null"), ["address"]), "address")
    strings = store.numbered(store.insert_or_ignore(tables["strings"].where("address is not null and content <> ''"), ["address"]), "address")
    ids = functions.select("id", "address")
    calls, lost_calls = resolve(tables["call_graph"], ids, "caller", "callee")
    graph = calls.select("caller_id", "callee_id", "call_addr").distinct()
    refs, lost_funcs = resolve(tables["func_string_refs"], ids, "func_addr")
    refs, lost_strings = resolve(refs, strings.select("id", "address"), "string_addr")
    addr = scalars.from_hex(F.col("ref_addr"))
    by_call = calls.select(F.col("caller_id").alias("func"), scalars.from_hex(F.col("call_addr")).alias("addr"), F.col("callee_id").alias("callee"), F.col("callee_id").alias("seq")).where("addr is not null")
    joined = next_call(refs.select(F.col("func_addr_id").alias("func"), addr.alias("addr"), F.col("string_addr_id").alias("string")).where("addr is not null"), by_call, tolerance)
    fanned = ref_fanout(joined).withColumn("ref_addr", scalars.to_hex(F.col("ref_addr")))
    return {
        "binary_functions": functions.select("id", "address", "name", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("is_library", F.lit(0)).alias("is_library")),
        "binary_strings": strings.select("id", "address", "content", "length"),
        "binary_call_graph": graph,
        "binary_func_string_refs": fanned,
        "skipped": lost_calls.agg(F.lit("call_graph").alias("table"), F.count("*").alias("n")).unionByName(lost_funcs.select("func_addr").unionByName(lost_strings.select("func_addr")).agg(F.lit("func_string_refs").alias("table"), F.count("*").alias("n"))),
    }
