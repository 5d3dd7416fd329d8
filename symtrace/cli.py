"""Command line:

    scan PATH OUT                     parse a source tree (or one file) into relations
    import JSON OUT                   import a disassembler's extract into relations
    match MODE SOURCES BINARIES OUT   match relations (Parquet folders or SQLite files); MODE is v2 or v3
    match MODE PREPARED OUT           the same from the six tables bin_info, src_info, bin_strings, src_strings, bin_edges, src_edges
    summary DIR | top DIR [N] [MIN] | candidates DIR [N] | search DIR NAME | export DIR FILE

Options of match: --phase NAME (repeatable) runs only these phases; --resume DIR starts from exported results. DIR is an
exported result."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from symtrace.plans import engine, report
    from symtrace.sources import extract, relations, source_scan

    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("symtrace").getOrCreate()
    command, path, *rest = args
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    if command == "match":
        options: dict[str, list[str]] = {"--phase": [], "--resume": []}
        while rest and (at := next((k for k, x in enumerate(rest) if x in options), None)) is not None:
            options[rest[at]] += rest[at + 1 : at + 2]
            del rest[at : at + 2]
        if path not in engine.MODES or len(rest) not in (2, 3):
            print(__doc__)
            return 2
        *tables, out = rest
        loader = relations.PreparedLoader(*tables) if len(tables) == 1 else relations.RelationLoader(*tables, path)
        state = engine.resume(spark, options["--resume"][-1]) if options["--resume"] else None
        engine.MatchEngine.of(path, options["--phase"], engine.PrintLogger()).execute(spark, loader, engine.ParquetExporter(out), state)
    elif command == "summary":
        for df in (report.overall(read("mapping_results")), report.buckets(read("mapping_results")), report.methods(read("mapping_results")), read("statistics").orderBy("phase")):
            df.show(truncate=False)
    elif command == "top":
        report.top(read("mapping_results"), int(rest[0]) if rest else 20, float(rest[1]) if len(rest) > 1 else 0.0).show(1000, truncate=False)
    elif command == "candidates":
        names = read("mapping_results").select("src_func_id", "src_func_name").distinct()
        report.top_candidates(read("mapping_candidates"), names, int(rest[0]) if rest else 10).show(1000, truncate=False)
    elif command == "search":
        report.search(read("mapping_results"), rest[0]).show(1000, truncate=False)
    elif command == "export":
        report.write_rename_script(read("mapping_results"), rest[0])
    elif command == "scan":
        for name, df in source_scan.source_relations(source_scan.parsed(source_scan.scan(spark, path))).items():
            df.write.mode("overwrite").parquet(f"{rest[0]}/{name}")
    elif command == "import":
        for name, df in extract.import_extract(extract.read_extract(spark, path)).items():
            df.write.mode("overwrite").parquet(f"{rest[0]}/{name}")
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
