"""``python -m massq.cli analyze|inspect|report``: entrapment analysis from the shell."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from massq.api import Session
from massq.operators import entrapment
from massq.sources import results, sinks


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="massq", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="classify entrapment hits and write tables")
    for name in ("--results", "--config", "--fasta", "--out"):
        analyze.add_argument(name, required=True)
    inspect = commands.add_parser("inspect", help="show what a result file holds")
    inspect.add_argument("results")
    report = commands.add_parser("report", help="statistics and a page of a classified table")
    report.add_argument("classified")
    report.add_argument("--out")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("massq").getOrCreate()
    if options.command == "report":
        rows = results.read_classified(spark, options.classified)
        stats = entrapment.statistics(rows)
        stats.show(truncate=False)
        entrapment.top_families(rows).show(truncate=False)
        if options.out:
            Path(options.out).write_text(sinks.page("Entrapment", stats))
        return 0
    if options.command == "inspect":
        rows = results.load_psms(spark, options.results)
        rows.printSchema()
        print(rows.count(), "matches")
        return 0
    found = Session(spark).classify_entrapment_hits(options.results, Path(options.config).read_text(), options.fasta)
    found.write.parquet(f"{options.out}/classified")
    found = spark.read.parquet(f"{options.out}/classified")
    sinks.write_tsv(sinks.classified_lines(found.withColumnsRenamed({"best_target": "best_target_peptide", "delta_mass": "delta_mass_da"})), f"{options.out}/classified_tsv")
    sinks.write_tsv(sinks.razor_errors(found.withColumnRenamed("best_target", "best_target_protein")), f"{options.out}/razor_errors_tsv")
    entrapment.statistics(found).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
