"""Queries through files: tables are written in the formats of the trade, and read by the library's readers and tools.

``events`` become spectra, ``documents`` and ``benchmark`` protein databases, ``lineitem``,
``orders`` and ``part`` results of other programs.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from massq.api import Session
from massq.functions import chem
from massq.functions import exprs as X
from massq.operators import advice, entrapment, inference, search, validate
from massq.operators import digest as D
from massq.operators import spectra as S
from massq.operators.shared import materialise, shared_path
from massq.plans.entrap import _CLASSES, _CLS, classified
from massq.plans.matching import _PSMS, psms, q_sql, table
from massq.plans.proteins import _BENCH, _SEQ, _STD, _TRYPSIN, _mass, sequences
from massq.plans.proteins import SQL as _PROTEIN_SQL
from massq.plans.signals import _COUNTS, _REVERSED, _S, _SHARE, _T, _ion_tables, _rounded, _timed, _wanted, spectra
from massq.sources import pfb
from massq.sources import proteins as P
from massq.sources import results as R
from massq.sources import sinks
from massq.sources import spectra as files


def _text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _written(rows: DataFrame, value: Column, suffix: str) -> str:
    path = f"{shared_path(rows.sparkSession)}{suffix}"
    rows.select(value.alias("value")).write.text(path)
    return path


def write_mgf(rows: DataFrame, scan: Column | None) -> str:
    """A folder of MGF files; without ``scan`` their blocks name none."""
    p = F.element_at("precursors", 1)
    peaks = F.array_join(F.transform(F.arrays_zip("mz", "intensity"), lambda x: F.concat((x["mz"] + 0.0).cast("string"), F.lit(" "), x["intensity"].cast("string"))), "\n")
    lines = [F.lit("BEGIN IONS"), F.concat(F.lit("RTINSECONDS="), _text(F.col("rt_min") * 60)), F.concat(F.lit("PEPMASS="), _text(p["mz"] + 0.0)), F.concat(F.lit("CHARGE="), _text(p["charge"]), F.lit("+"))]
    lines += [] if scan is None else [F.concat(F.lit("SCANS="), _text(scan))]
    return _written(rows, F.concat_ws("\n", *lines, peaks, F.lit("END IONS")), ".mgf")


@F.pandas_udf(StringType())
def _coded(values: pd.Series) -> pd.Series:
    return pd.Series([base64.b64encode(np.asarray(v, "<f8").tobytes()).decode() for v in values])


def write_mzml(rows: DataFrame, scan: Column) -> str:
    param = lambda name, value, more="": F.concat(F.lit(f'<cvParam accession="{name}" value="'), _text(value), F.lit(f'"{more}/>'))
    p = F.try_element_at("precursors", F.lit(1))
    window = F.concat(*[param(f"MS:{k}", p["isolation"][f]) for k, f in ((1000827, "target"), (1000828, "lower"), (1000829, "upper"))])
    selected = F.concat(F.lit("<precursorList><precursor>"), window, param("MS:1000744", p["mz"]), param("MS:1000041", p["charge"]), F.lit("</precursor></precursorList>"))
    array = lambda name, c: F.concat(F.lit(f'<binaryDataArray><cvParam accession="{name}" value=""/><binary>'), _coded(c), F.lit("</binary></binaryDataArray>"))
    head = F.concat(F.lit('<spectrum index="0" id="scan='), _text(scan), F.lit('">'), param("MS:1000511", "ms_level"), param("MS:1000016", "rt_min", ' unitAccession="UO:0000031"'))
    return _written(rows, F.concat(head, F.coalesce(selected, F.lit("")), array("MS:1000514", "mz"), array("MS:1000515", "intensity"), F.lit("</spectrum>")), ".mzML")


def write_fasta(proteins: DataFrame, prefix: str = "") -> str:
    """Sequences of two lines, with a description."""
    half = F.floor(F.length("sequence") / 2).cast("int")
    name = F.concat(F.lit(f">{prefix}"), F.col("accession"))
    return _written(proteins, F.concat(name, F.lit(" some protein\n"), F.substring(F.col("sequence"), F.lit(1), half), F.lit("\n"), F.substring(F.col("sequence"), half + 1, F.length("sequence"))), ".fasta")


def _number() -> Column:
    return F.col("run").cast("int") * 100 + F.col("scan")


def file_formats(spark, d):
    """Names of parts with endings of all kinds."""
    ends = F.element_at(F.array(*map(F.lit, (".mgf", ".MZML", ".pfb", ".parquet", ".tsv", ".json", ".txt", ".raw", ""))), (F.col("p_partkey") % 9 + 1).cast("int"))
    name = F.concat(F.lit("/runs/"), "p_name", ends)
    return table(spark, d, "part").groupBy(files.format_of(name).alias("spectra"), R.format_of(name).alias("results")).agg(F.count(F.lit(1)).alias("n"))


def mgf_scan(spark, d):
    rows = S.by_level(spectra(spark, d), 2)
    found, p = files.read(spark, write_mgf(rows, _number())), F.element_at("precursors", 1)
    return _rounded(found.select("scan", "rt_min", p["mz"].alias("mz"), p["charge"].alias("charge"), F.size("mz").cast("long").alias("peaks"), F.aggregate("intensity", F.lit(0.0), lambda a, x: a + x).alias("total")))


def mzml_scan(spark, d):
    found, p = files.read(spark, write_mzml(spectra(spark, d), _number())), F.try_element_at("precursors", F.lit(1))
    return _rounded(found.select("scan", "ms_level", "rt_min", p["isolation"]["target"].alias("target"), p["isolation"]["lower"].alias("lower"), F.size("mz").cast("long").alias("peaks"), F.element_at("mz", -1).alias("last_mz")))


def pfb_scan(spark, d):
    """A file a run, written where its spectra are, then read in ranges of records."""
    fs, place = pfb.opened(folder := shared_path(spark))
    fs.create_dir(place, recursive=True)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        body, at = [], []
        for r in rows.sort_values("scan").itertuples():
            fields = [""] * 13
            fields[0], fields[1], fields[2], fields[4], fields[7], fields[10] = str(r.scan), str(r.ms_level), str(r.rt_min * 60), "2", str(r.scan), "4"
            text = "\t".join(fields).encode()
            at.append(24 + sum(map(len, body)))
            body.append(struct.pack("<i", len(text)) + text + struct.pack("<i", len(r.mz)) + np.asarray(r.mz, "<f8").tobytes() + np.asarray(r.intensity, "<f8").tobytes())
        content = b"".join(body)
        head = b"\0" * 12 + struct.pack("<qi", 24 + len(content), len(at))
        name = f"{rows.run.iloc[0]}.pfb"
        with pfb.opened(folder)[0].open_output_stream(f"{place}/{name}") as out:  # played again, a task writes the same
            out.write(head + content + b"".join(struct.pack("<q", x) for x in at))
        return pd.DataFrame({"name": [name]})

    rows = spectra(spark, d).select("run", "scan", "ms_level", "rt_min", "mz", "intensity")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a file costs time and few bytes, by which Spark would leave them to few tasks
    written = rows.repartition(tasks, "run").groupBy("run").applyInPandas(build, "name string")
    written.write.format("noop").mode("overwrite").save()
    pfb.register(spark)
    w = F.try_element_at("precursors", F.lit(1))["isolation"]
    return spark.read.format("pfb").option("splitBytes", 1 << 16).load(folder).select("run", "scan", "ms_level", "rt_min", w["target"].alias("target"), w["lower"].alias("lower"), F.size("mz").cast("long").alias("peaks"))


def sharded_union(spark, d):
    """MGF and mzML of the same scans as one table."""
    rows = spectra(spark, d)
    both = files.read_many(spark, [write_mgf(S.by_level(rows, 2), _number()), write_mzml(rows, _number())])
    return both.groupBy("ms_level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("scan").alias("scans"), F.sum(F.size("mz")).cast("long").alias("peaks"))


def spectrum_lookup(spark, d):
    """Scan 10 of all runs from the ingested table."""
    kept = files.ingest(spectra(spark, d), shared_path(spark))
    return S.spectrum(kept, 10).select("run", "rt_min", F.size("mz").cast("long").alias("peaks"))


def all_metadata(spark, d):
    return S.metadata(spectra(spark, d)).select("run", "scan", "ms_level", "rt_min", F.col("isolation.target").alias("target"))


def isolation_containment(spark, d):
    """How many of a run's orders' m/z lie inside windows of its MS2 scans."""
    w = S.metadata(spectra(spark, d), 2).select("run", "scan", "isolation")
    inside = X.window_contains(F.col("isolation.target"), F.col("isolation.lower"), F.col("isolation.upper"), F.col("heavy_mz"))
    return _wanted(spark, d).join(w, "run").groupBy("run").agg(F.count_if(inside).alias("inside"), F.count(F.lit(1)).alias("pairs"))


def fasta_scan(spark, d):
    found = P.read_fasta(spark, write_fasta(sequences(spark, d).withColumn("sequence", F.lower("sequence"))))
    return found.select("accession", "description", F.md5(F.col("sequence").cast("binary")).alias("sequence"))


def fasta_coverage_scan(spark, d):
    """Case and empty entries stay, lines that begin like comments go."""
    s = sequences(spark, d).withColumn("sequence", F.concat(F.lit("#note\n"), F.lower("sequence")))
    path = _written(s, F.concat(F.lit(">"), "accession", F.lit("\n"), "sequence"), ".fasta")
    return P.read_fasta(spark, path, upper=False, keep_empty=True, comments=True).select("accession", F.md5(F.col("sequence").cast("binary")).alias("sequence"))


def protein_count(spark, d):
    path = write_fasta(sequences(spark, d))
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents")).select("documents", F.lit(P.count_proteins(spark, path)).cast("long").alias("proteins"))


def fasta_peek(spark, d):
    """The first accessions of a file: here of one that holds the highest supplier names first."""
    s = table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("accession"), F.lit("PEPTIDEK").alias("sequence")).orderBy(F.desc("accession")).coalesce(1)
    found = P.first_accessions(spark, write_fasta(s))
    return table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("accession")).where(F.col("accession").isin(*found))


def accession_list(spark, d):
    lines = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "# ").otherwise("  "), "s_name", F.when(F.col("s_suppkey") % 2 == 0, "\n\n").otherwise(""))
    return P.read_accessions(spark, _written(table(spark, d, "supplier"), lines, ".txt"))


def organism_ids(spark, d):
    """Databases that organisms' names ask for, spread over customers."""
    names = ("Human", "mus musculus (Mouse)", "E. coli", "Baker's YEAST", "arabidopsis thaliana", "9606", "crap", "martian")
    of = F.create_map(*[F.lit(x) for n in names for x in (n, P.organism_database(n) or "")])
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, d, "customer").groupBy(F.element_at(of, name).alias("database")).agg(F.count(F.lit(1)).alias("n"))


def _diann(spark, d) -> str:
    """lineitem as a report of another program; every fourth row has no charge."""
    li, path = table(spark, d, "lineitem"), f"{shared_path(spark)}.parquet"
    names = {"Modified.Sequence": F.concat(F.lit("_AC(UniMod:4)K"), F.translate(_text("l_partkey"), "0123456789", "ACDEFGHILK"), F.lit("_")), "Stripped.Sequence": F.translate(_text("l_partkey"), "0123456789", "ACDEFGHILK"), "Precursor.Charge": F.col("l_linenumber") % 4, "Precursor.Mz": F.col("l_extendedprice"), "RT": F.col("l_quantity"), "Q.Value": F.col("l_discount"), "Run": F.concat(F.lit("run"), "l_returnflag"), "Protein.Names": F.concat_ws(";", _text("l_suppkey"), F.lit("second")), "Protein.Ids": _text("l_suppkey")}
    li.select(*[c.alias(n) for n, c in names.items()]).write.parquet(path)
    return path


def _imported(rows: DataFrame) -> DataFrame:
    return _rounded(rows.groupBy("run", "charge").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("peptides"), F.max("score").alias("best"), F.sum("rt_min").alias("rt"), F.sum(F.size("accessions")).cast("long").alias("accessions")), 6)


def import_diann(spark, d):
    return _imported(R.import_results(spark, _diann(spark, d), 0.05))


def import_diann_run(spark, d):
    return _imported(R.import_results(spark, _diann(spark, d), 0.02, "runA"))


def entrapment_diann(spark, d):
    return R.load_psms(spark, _diann(spark, d)).groupBy("run", "charge").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("peptides"), F.countDistinct("protein_ids").alias("proteins"), F.count("rt_start").alias("with_start"))


def import_rollup(spark, d):
    """Peptides of an import: best score, smallest q-value, accessions."""
    rows = R.import_results(spark, _diann(spark, d), 0.05).withColumn("accession", F.element_at("accessions", 1))
    return search.peptide_rollup(rows).select("peptide", F.round("best_score", 6).alias("best_score"), "q_value", F.array_join("accessions", ";").alias("accessions"), "psm_count")


def import_proteins(spark, d):
    rows = R.import_results(spark, _diann(spark, d), 0.05)
    return search.protein_rollup(rows.withColumn("accession", F.explode("accessions")))


def import_report(spark, d):
    """Imports of which those of short retention have no scan."""
    rows = R.import_results(spark, _diann(spark, d), 0.05).withColumn("scan", F.when(F.col("rt_min") > 10, F.col("precursor_mz").cast("int")))
    return _rounded(search.import_summary(rows, q=0.03))


def _pfind(spark, d) -> str:
    o, path = table(spark, d, "orders"), f"{shared_path(spark)}.tsv"
    names = {"FileName": F.concat(F.lit("run"), F.substring("o_orderpriority", 1, 1)), "PeptideSequence": F.translate(_text("o_orderkey"), "0123456789", "ACDEFGHILK"), "CleavageType": F.lit("3"), "ProNCTerm": F.lit(""), "Modifications": F.lit("1,Oxidation[M];"), "PredRT": _text(F.col("o_orderkey") % 100), "Proteins": F.concat(F.lit("p"), _text(F.col("o_custkey") % 50), F.lit("/q/")), "MH+": _text("o_totalprice"), "Charge": F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(_text(F.col("o_orderkey") % 3 + 1)), "ScanNo": _text("o_orderkey"), "FinalScore": _text(F.col("o_totalprice") / 1000), "QValue": F.lit("0.001"), "DeltaRT(Min)": F.lit("0")}
    sinks.write_tsv(o.select(*[c.alias(n) for n, c in names.items()]), path)
    return path


def import_pfind(spark, d):
    return _imported(R.import_results(spark, _pfind(spark, d)))


def entrapment_pfind(spark, d):
    rows = R.load_psms(spark, _pfind(spark, d))
    return _rounded(rows.groupBy("run", "charge").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("protein_ids").alias("proteins"), F.sum("precursor_mz").alias("mz")), 2)


def generic_table(spark, d):
    o, path = table(spark, d, "part"), f"{shared_path(spark)}.tsv"
    rows = o.select(F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_name")).alias("seq"), F.col("p_brand").alias("protein_ids"), _text("p_size").alias("charge"), F.when(F.col("p_size") > 9, "n/a").otherwise("0.5").alias("q_value"))
    sinks.write_tsv(rows, path)
    found = R.load_psms(spark, path, {"peptide": "seq"})
    return found.groupBy("protein_ids").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("peptides"), F.sum("charge").cast("long").alias("charges"), F.count("q_value").alias("with_q"), F.count("scan").alias("with_scan"))


def annotation_list(spark, d):
    line = F.concat_ws("\t", _text("o_orderkey"), F.translate(_text("o_custkey"), "0123456789", "ACDEFGHILK"), _text(F.col("o_orderkey") % 3 + 1), F.when(F.col("o_orderkey") % 2 == 0, "0:57.02;3:15.99").otherwise(""))
    found = R.read_annotations(spark, _written(table(spark, d, "orders"), line, ".tsv"))
    return _rounded(found.groupBy("charge").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("peptides"), F.sum(F.aggregate("mods", F.lit(0.0), lambda t, m: t + m["delta"])).alias("added"), F.max("scan").alias("last")), 2)


def classified_reread(spark, d):
    """Statistics of the classified table after it was written and read again."""
    path = shared_path(spark)
    sinks.write_tsv(sinks.classified_lines(classified(spark, d).withColumnRenamed("delta_mass", "delta_mass_da")), path)
    return _rounded(entrapment.statistics(R.read_classified(spark, path)), 4)


def result_json(spark, d):
    path = shared_path(spark)
    sinks.write_json(psms(spark, d), path)
    return _rounded(search.summary(spark.read.schema("peptide string, accession string, score double, q_value double, delta_ppm double, charge int").json(path)))


def file_digests(spark, d):
    """Length and SHA-256 of a file of supplier names."""
    path = _written(table(spark, d, "supplier").orderBy("s_name").select("s_name").coalesce(1), F.col("s_name"), ".txt")
    return sinks.file_digests(spark, f"{path}/*.txt").select("length", "sha256")


def run_metadata(spark, d):
    path = _written(table(spark, d, "supplier").orderBy("s_name").select("s_name").coalesce(1), F.col("s_name"), ".txt")
    found = sinks.run_metadata(classified(spark, d), sinks.file_digests(spark, f"{path}/*.txt"), {"missed": 2})
    return found.select(F.explode("levels").alias("l"), F.size("inputs").alias("inputs"), "settings").select("l.*", "inputs", "settings")


def validation(spark, d):
    """Matches of which many break rules: how often each set of rules is broken."""
    li = table(spark, d, "lineitem")
    n = F.col("l_orderkey") % 10
    rows = li.select((F.col("l_linenumber") - 1).alias("scan"), F.when(n == 1, " ").otherwise("PEK").alias("peptide"), (n % 5).alias("charge"), F.when(n == 2, float("nan")).when(n == 3, -1.0).otherwise(F.col("l_quantity")).alias("precursor_mz"), F.col("l_quantity").alias("calculated_mz"), F.when(n == 4, float("inf")).otherwise(0.0).alias("delta_ppm"), F.col("l_extendedprice").alias("score"), F.when(n == 6, 1.5).when(n == 7, None).otherwise(F.col("l_discount")).alias("q_value"), F.when(n == 8, F.array().cast("array<string>")).otherwise(F.array(F.lit("p"))).alias("accessions"))
    return validate.matches(rows).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def validation_proteins(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.when(F.col("p_size") == 1, "").otherwise(F.col("p_name")).alias("accession"), (F.col("p_size") / 40).alias("coverage"), (F.col("p_partkey") % 5).alias("unique_peptide_count"), (F.col("p_size") % 5).alias("peptide_count"))
    return validate.proteins(rows).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def validation_groups(spark, d):
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.when(F.col("p_size") == 1, "").otherwise(F.col("p_brand")).alias("leader"), F.array("p_brand").alias("members"), F.array("p_name").alias("peptides"), F.when(F.col("p_size") > 5, F.col("p_size") / 40).alias("coverage"), F.lit(0.5).alias("q_value"))
    return validate.groups(rows).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def run_names(spark, d):
    """Names of runs that may and may not be joined to a folder."""
    name = F.concat(F.element_at(F.array(*map(F.lit, ("", "../", "a\\", "x.", "/"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.when(F.col("p_size") % 3 == 0, ".").when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_name")))
    return table(spark, d, "part").groupBy(validate.bare_name(name).alias("bare")).agg(F.count(F.lit(1)).alias("n"))


def _database(spark, d) -> DataFrame:
    return sequences(spark, d, "benchmark", "item_id")


def _made(spark, d) -> DataFrame:
    """A spectrum of each distinct benchmark peptide: charge 2, the precursor 3 ppm off, every second b and y ion."""
    p = D.digest(_database(spark, d), missed=0).select("peptide").distinct()
    ions = F.filter(chem.theoretical_ions(F.col("peptide"), None, 1), lambda x: x["number"] % 2 == 0)
    peaks = F.array_sort(F.transform(ions, lambda x: F.struct(x["mz"].alias("mz"), x["number"].cast("double").alias("intensity"))))
    mz = chem.mz(chem.peptide_mass(F.col("peptide")), F.lit(2)) * (1 + 3e-6)
    one = F.array(F.struct(mz.alias("mz"), F.lit(2).alias("charge"), F.lit(None).cast("double").alias("intensity"), F.lit(None).cast("struct<target:double,lower:double,upper:double>").alias("isolation"), F.lit(None).cast("int").alias("source_scan")))
    return materialise(p.select(F.col("peptide").alias("run"), F.lit(1).alias("scan"), F.lit(2).alias("ms_level"), F.lit(1.0).alias("rt_min"), one.alias("precursors"), peaks.alias("p")).select("run", "scan", "ms_level", "rt_min", "precursors", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"), F.lit("centroid").alias("representation")))


def search_matches(spark, d):
    """Best matches with q-values, decoys too: each spectrum is named after the peptide it was made of."""
    found = search.search(_made(spark, d), _database(spark, d), drop_decoys=False, missed=0)
    return found.select("run", "peptide", "is_decoy", F.col("matched").cast("long").alias("matched"), F.col("total").cast("long").alias("total"), F.round("q_value", 9).alias("q_value"))


def search_da(spark, d):
    """How many candidates, and which mass differences, half a Da of m/z lets in."""
    found = search.matches_within(_made(spark, d), search.candidates(_database(spark, d), missed=0), 0.5, "Da")
    return _rounded(found.groupBy("run").agg(F.count(F.lit(1)).alias("candidates"), F.max(F.abs(F.col("precursor_mz") - F.col("calculated_mz"))).alias("widest")), 5)


def tool_search(spark, d):
    """A search from files to its summary, through a session."""
    s = Session(spark)
    params = advice.Params(fixed=(), variable=(), missed=0)
    run = s.run_search(write_fasta(_database(spark, d)), [write_mgf(_made(spark, d), None)], params=params)
    if s.get_search_status(run)["status"] != "completed":
        raise RuntimeError(s.get_search_status(run)["error"])
    return s.generate_summary(run).select("psms", "psms_at_q", "peptides_at_q")


def tool_export(spark, d):
    """The peptide table that a search exports, read again."""
    s, out = Session(spark), shared_path(spark)
    run = s.run_search(write_fasta(_database(spark, d)), [write_mgf(_made(spark, d), None)], params=advice.Params(fixed=(), variable=(), missed=0))
    s.export_results(run, out)
    return spark.read.csv(f"{out}/peptide", sep="\t", header=True).select("sequence", F.col("psm_count").cast("long").alias("psm_count"), F.col("q_value").isNotNull().alias("has_q"))


def tool_read_spectra(spark, d):
    """What a session says of an MGF file, its parts taken together."""
    found = Session(spark).read_spectra(write_mgf(S.by_level(spectra(spark, d), 2), _number()))
    return found.agg(F.sum("spectra").alias("spectra"), F.sum("ms2").alias("ms2"), F.min("mz_min").alias("mz_min"), F.max("mz_max").alias("mz_max"), F.round(F.min("rt_from"), 6).alias("rt_from"), F.round(F.max("rt_to"), 6).alias("rt_to"))


def tool_get_spectrum(spark, d):
    """The peaks of the last scan of all."""
    rows = spectra(spark, d)
    scan = rows.agg(F.max(_number())).first()[0]
    found = Session(spark).get_spectrum(write_mzml(rows, _number()), scan)
    return found.select("scan", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("scan", "p.mz", "p.intensity")


def tool_find_by_time(spark, d):
    wanted = _wanted(spark, d).select("id", "run", F.col("rt").alias("rt_min"), F.col("heavy_mz").alias("precursor_mz"))
    return Session(spark).find_by_time(_timed(spark, d), wanted, 100.0).select("id", "scan", F.round("distance", 6).alias("distance"))


def tool_import(spark, d):
    return _imported(Session(spark).import_search_results(_diann(spark, d), q=0.05))


def tool_classify(spark, d):
    """Conversation peptides against a FASTA file of benchmark texts, by a configuration in YAML."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("sequence"))
    rows, path = D.digest(c, missed=0, shortest=6, keep=("conv_id", "turn")), f"{shared_path(spark)}.parquet"
    rows.select(F.col("peptide").alias("Stripped.Sequence"), F.concat(F.lit("c"), _text("conv_id")).alias("Protein.Ids")).write.parquet(path)
    config = "version: 1\ntarget:\n  - regex: '^t'\ntrap:\n  - regex: '^c'\n"
    s = Session(spark)
    found = materialise(s.classify_entrapment_hits(path, config, write_fasta(_database(spark, d), "t")))
    return s.analyze_entrapment_stats(found).select("group", "level", "n", F.round("mass_mean", 4).alias("mass_mean"))


def tool_similar(spark, d):
    """The class of one peptide, the first benchmark peptide with its first letter changed."""
    first = D.digest(_database(spark, d), missed=0).agg(F.min("peptide")).first()[0]
    return Session(spark).find_similar_targets("W" + first[1:], write_fasta(_database(spark, d))).select("peptide", "level", "best_target")


def engine_features(spark, d):
    """lineitem as features of another engine: matches, m/z from masses."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.when(F.col("l_linenumber") == 7, "none").otherwise(_text("l_orderkey")).alias("spec_id"), _text("l_partkey").alias("peptide"), F.array(_text("l_suppkey")).alias("accessions"), (F.col("l_linenumber") % 4).alias("charge"), F.col("l_extendedprice").alias("expmass"), (F.col("l_extendedprice") + 0.01).alias("calcmass"), F.col("l_quantity").alias("hyperscore"), F.col("l_discount").alias("spectrum_q"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("label"), F.col("l_tax").alias("delta_next"))
    found = search.features_to_matches(rows, ("delta_next",))
    return _rounded(found.groupBy("charge", "is_decoy").agg(F.count(F.lit(1)).alias("n"), F.min("scan").alias("least_scan"), F.sum("calculated_mz").alias("mz"), F.min("delta_ppm").alias("least_ppm"), F.max(F.col("extra")["delta_next"]).alias("most_next")), 3)


def _features(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(_text("l_partkey").alias("peptide"), F.array(_text("l_suppkey"), _text(F.col("l_suppkey") % 7)).alias("accessions"), F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("q_value"), (F.col("l_returnflag") == "R").alias("is_decoy"))


def rescored_peptides(spark, d):
    return search.rescored_rollup(_features(spark, d))[0].withColumn("accessions", F.array_join("accessions", ";"))


def rescored_proteins(spark, d):
    return search.rescored_rollup(_features(spark, d))[1]


def extraction_statistics(spark, d):
    found = S.extraction_statistics(spectra(spark, d))
    return found.select("run", "ms2", "precursors", F.round("per_ms2", 6).alias("per_ms2"), F.array_join(F.transform(F.map_entries("charges"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("charges"))


def group_coverage(spark, d):
    """Coverage of each document's sequence as a group of its own by its tryptic peptides."""
    s = sequences(spark, d)
    own = D.digest(s, missed=0).groupBy(F.col("accession").alias("leader")).agg(F.collect_set(X.fold_il(F.col("peptide"))).alias("peptides"))
    return _rounded(inference.coverage(own.withColumn("razor_peptides", F.array().cast("array<string>")), s))


def heavy_annotation(spark, d):
    """Ions of each made spectrum's heavy partner that the light peaks explain."""
    rows = _made(spark, d)
    found = S.annotate_heavy(rows, rows.select("run", "scan", F.col("run").alias("peptide")), 20.0, 1)
    return found.groupBy("run").agg(F.count(F.lit(1)).alias("ions"), F.count_if("matched").alias("matched"))


def substituted_mods(spark, d):
    """Mass of modifications where two spellings of a part's name differ."""
    p = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("a"), F.upper(F.translate("p_name", "aeiou", "AEuio")).alias("b"), F.array(F.struct(F.lit(1).alias("pos"), F.lit(10.0).alias("mass")), F.struct((F.col("p_size") % 8).alias("pos"), F.lit(1.5).alias("mass"))).alias("m"))
    return p.select("p_partkey", X.mod_mass_at(F.col("m"), X.differences(F.col("a"), F.col("b"))).alias("mass"))


def traced_provenance(spark, d):
    """Traps against targets, by the spectra of their runs: here every peptide's own, against its reverse."""
    rows = _made(spark, d)
    c = rows.select(F.col("run").alias("id"), "run", F.when(F.length("run") % 2 == 0, 1).alias("scan"), "rt_min", F.col("run").alias("peptide"), D.reverse_decoy(F.col("run")).alias("best_target"), F.lit("trap").alias("group"), F.when(F.length("run") % 3 == 0, "L0").otherwise("L3").alias("level"))
    return _rounded(S.trace_provenance(c, rows, least_peaks=8).select("id", "trap_only", "target_only", "shared", "unassigned", "shared_ratio"))


QUERIES = {f.__name__: f for f in (file_formats, mgf_scan, mzml_scan, pfb_scan, sharded_union, spectrum_lookup, all_metadata, isolation_containment, fasta_scan, fasta_coverage_scan, protein_count, fasta_peek, accession_list, organism_ids, import_diann, import_diann_run, entrapment_diann, import_rollup, import_proteins, import_report, import_pfind, entrapment_pfind, generic_table, annotation_list, classified_reread, result_json, file_digests, run_metadata, validation, validation_proteins, validation_groups, run_names, search_matches, search_da, tool_search, tool_export, tool_read_spectra, tool_get_spectrum, tool_find_by_time, tool_import, tool_classify, tool_similar, engine_features, rescored_peptides, rescored_proteins, extraction_statistics, group_coverage, heavy_annotation, substituted_mods, traced_provenance)}

_LETTERS = "translate({}::VARCHAR, '0123456789', 'ACDEFGHILK')"
_DIANN = f"r AS (SELECT 'run' || l_returnflag AS run, l_linenumber % 4 AS charge, 'ACK' || {_LETTERS.format('l_partkey')} AS peptide, {_LETTERS.format('l_partkey')} AS stripped, 1 - l_discount AS score, l_discount AS q, l_quantity AS rt, l_suppkey, l_extendedprice AS mz FROM lineitem)"
_IMPORTED = "SELECT run, charge::INT AS charge, count(*) AS n, count(DISTINCT peptide) AS peptides, round(max(score), 6) AS best, round(sum(rt)::DOUBLE, 6) AS rt, 2 * count(*) AS accessions FROM r WHERE charge > 0 AND {} GROUP BY 1, 2"
_NAMES = "regexp_matches(upper(e), '{}')"
_PFIND = f"r AS (SELECT 'run' || o_orderpriority[1:1] AS run, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 + 1 END AS charge, {_LETTERS.format('o_orderkey')} AS peptide, o_orderkey % 100 AS rt, o_totalprice AS mh, o_totalprice / 1000 AS score, 'p' || (o_custkey % 50) || ';q' AS proteins FROM orders)"
_CAND = f"""{_BENCH}, db AS (SELECT accession, s, false AS dec FROM seq UNION ALL SELECT 'REV_' || accession, reverse(s[1:len(s) - 1]) || s[len(s):], true FROM seq),
pcs AS (SELECT accession, dec, {_TRYPSIN} AS f FROM db), pc AS (SELECT accession, dec, f[i] AS peptide, i FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM pcs)),
cand AS (SELECT peptide, min(struct_pack(d := dec, a := accession, o := i)) AS m, {_mass("peptide")} + 18.010565::DOUBLE AS mass FROM pc WHERE len(peptide) BETWEEN 7 AND 50 AND regexp_full_match(peptide, '{_STD}') GROUP BY peptide),
sp AS (SELECT DISTINCT peptide AS run, ((mass + 2 * 1.007276::DOUBLE) / 2) * (1 + 3e-6::DOUBLE) AS pmz FROM cand WHERE NOT m.d), near AS (SELECT run, pmz, peptide, m, (mass + 2 * 1.007276::DOUBLE) / 2 AS cmz FROM sp JOIN cand ON {{}})"""
_MADE = f"""si AS (SELECT run, unnest(range(1, len(run))) AS n FROM sp), sions AS (SELECT run, n, {_mass("run[1:n]")} + 1.007276::DOUBLE AS mz FROM si UNION ALL SELECT run, n, {_mass("run[len(run) - n + 1:]")} + 18.010565::DOUBLE + 1.007276::DOUBLE FROM si), peak AS (SELECT run, mz AS pk FROM sions WHERE n % 2 = 0)"""
_FOUND = f"""WITH {_CAND.format("abs((pmz - (mass + 2 * 1.007276::DOUBLE) / 2) / ((mass + 2 * 1.007276::DOUBLE) / 2)) * 1e6 <= 10")}, {_MADE}, ni AS (SELECT run, peptide, unnest(range(1, len(peptide))) AS n FROM near),
ions AS (SELECT run, peptide, 'b' || n AS ion, {_mass("peptide[1:n]")} + 1.007276::DOUBLE AS mz FROM ni UNION ALL SELECT run, peptide, 'y' || n, {_mass("peptide[len(peptide) - n + 1:]")} + 18.010565::DOUBLE + 1.007276::DOUBLE FROM ni),
hit AS (SELECT DISTINCT run, peptide, ion FROM ions JOIN peak USING (run) WHERE abs(pk - mz) <= mz * 20e-6), cnt AS (SELECT run, peptide, count(*) AS matched FROM hit GROUP BY 1, 2),
b AS (SELECT run, peptide, m.d AS is_decoy, matched, 2 * (len(peptide) - 1) AS total, matched / (2 * (len(peptide) - 1)) AS score, row_number() OVER (PARTITION BY run ORDER BY matched / (2 * (len(peptide) - 1)) DESC, m.d, m.a, m.o) AS k FROM near JOIN cnt USING (run, peptide)),
r AS (SELECT * FROM b WHERE k = 1), {q_sql("r")}, qd AS (SELECT r.*, q_value FROM r JOIN q ON r.score = q.score)"""
_COVERED = _PROTEIN_SQL["sequence_coverage"]
SQL = {
    "file_formats": "WITH p AS (SELECT ['mgf', 'mzml', 'pfb', NULL, NULL, NULL, NULL, NULL, NULL][p_partkey % 9 + 1] AS spectra, [NULL, NULL, NULL, 'parquet', 'generic_tsv', 'json', 'generic_tsv', NULL, NULL][p_partkey % 9 + 1] AS results FROM part) SELECT spectra, results, count(*) AS n FROM p GROUP BY 1, 2",
    "mgf_scan": f"WITH {_S}, t AS (SELECT run, scan, sum(i) AS total FROM e GROUP BY 1, 2) SELECT (run::INT * 100 + scan)::INT AS scan, rt_min, round(lo, 6) AS mz, (scan % 4 + 1)::INT AS charge, n AS peaks, total FROM s JOIN t USING (run, scan) WHERE ms_level = 2",
    "mzml_scan": f"WITH {_S} SELECT (run::INT * 100 + scan)::INT AS scan, ms_level::INT AS ms_level, rt_min, CASE WHEN ms_level = 2 THEN target END AS target, CASE WHEN ms_level = 2 THEN half END AS lower, n AS peaks, round(hi, 6) AS last_mz FROM s",
    "pfb_scan": f"WITH {_S} SELECT run, scan, ms_level::INT AS ms_level, rt_min, CASE WHEN ms_level = 2 THEN scan::DOUBLE END AS target, CASE WHEN ms_level = 2 THEN 2.0::DOUBLE END AS lower, n AS peaks FROM s",
    "sharded_union": f"WITH {_S} SELECT ms_level::INT AS ms_level, count(*) * ms_level AS n, count(*) AS scans, (sum(n) * ms_level)::BIGINT AS peaks FROM s GROUP BY ms_level",
    "spectrum_lookup": f"WITH {_S} SELECT run, rt_min, n AS peaks FROM s WHERE scan = 10",
    "all_metadata": f"WITH {_S} SELECT run, scan, ms_level::INT AS ms_level, rt_min, CASE WHEN ms_level = 2 THEN target END AS target FROM s",
    "isolation_containment": f"WITH {_S} SELECT run, count(*) FILTER (o_orderkey % 487 + 1 BETWEEN target - half AND target + half) AS inside, count(*) AS pairs FROM orders JOIN s ON run = o_custkey::VARCHAR AND ms_level = 2 GROUP BY 1",
    "fasta_scan": f"WITH {_SEQ} SELECT accession, accession || ' some protein' AS description, md5(s) AS sequence FROM seq WHERE s <> ''",
    "fasta_coverage_scan": f"WITH {_SEQ} SELECT accession, md5(lower(s)) AS sequence FROM seq",
    "protein_count": "SELECT count(*) AS documents, count(*) AS proteins FROM documents",
    "fasta_peek": "SELECT lpad(s_suppkey::VARCHAR, 9, '0') AS accession FROM supplier ORDER BY 1 DESC LIMIT 5",
    "accession_list": "SELECT DISTINCT s_name AS accession FROM supplier WHERE s_suppkey % 3 > 0",
    "organism_ids": "SELECT ['human_swissprot', 'mouse_swissprot', 'ecoli_swissprot', 'yeast_swissprot', 'arabidopsis_swissprot', 'human_swissprot', 'crap', ''][c_custkey % 8 + 1] AS database, count(*) AS n FROM customer GROUP BY 1",
    "import_diann": f"WITH {_DIANN} {_IMPORTED.format('q <= 0.05')}",
    "import_diann_run": f"WITH {_DIANN} " + _IMPORTED.format("q <= 0.02 AND run = 'runA'"),
    "tool_import": f"WITH {_DIANN} {_IMPORTED.format('q <= 0.05')}",
    "entrapment_diann": f"WITH {_DIANN} SELECT run, charge::INT AS charge, count(*) AS n, count(DISTINCT stripped) AS peptides, count(DISTINCT l_suppkey) AS proteins, 0::BIGINT AS with_start FROM r GROUP BY 1, 2",
    "import_rollup": f"WITH {_DIANN} SELECT peptide, round(max(score), 6) AS best_score, min(q) AS q_value, array_to_string(list_sort(list(DISTINCT l_suppkey::VARCHAR)), ';') AS accessions, count(*) AS psm_count FROM r WHERE charge > 0 AND q <= 0.05 GROUP BY 1",
    "import_proteins": f"WITH {_DIANN}, a AS (SELECT DISTINCT peptide, unnest([l_suppkey::VARCHAR, 'second']) AS accession FROM r WHERE charge > 0 AND q <= 0.05), o AS (SELECT peptide, count(*) AS k FROM a GROUP BY 1) SELECT accession, count(*) AS peptide_count, count(*) FILTER (k = 1) AS unique_peptide_count FROM a JOIN o USING (peptide) GROUP BY 1",
    "import_report": f"WITH {_DIANN}, m AS (SELECT *, rt > 10 AS has, rt > 10 AND q <= 0.03 AS good, floor(mz)::INT AS scan FROM r WHERE charge > 0 AND q <= 0.05) SELECT count(*) AS imported, count(*) FILTER (has) AS matched, count(DISTINCT run) AS runs, count(*) FILTER (good) AS psms_at_q, count(DISTINCT CASE WHEN good THEN peptide END) AS peptides_at_q, count(DISTINCT CASE WHEN has THEN (run, scan) END) AS scans, round(count(*) FILTER (good) / count(*) FILTER (has), 6) AS identification_rate FROM m",
    "import_pfind": f"WITH {_PFIND} {_IMPORTED.format('true')}",
    "entrapment_pfind": f"WITH {_PFIND} SELECT run, charge::INT AS charge, count(*) AS n, count(DISTINCT proteins) AS proteins, round(sum((mh + (charge - 1) * 1.007276) / charge), 2) AS mz FROM r GROUP BY 1, 2",
    "generic_table": "SELECT p_brand AS protein_ids, count(*) AS n, count(DISTINCT p_name) AS peptides, sum(p_size)::BIGINT AS charges, count(*) FILTER (p_size <= 9) AS with_q, 0::BIGINT AS with_scan FROM part WHERE p_size % 7 > 0 GROUP BY 1",
    "annotation_list": "SELECT (o_orderkey % 3 + 1)::INT AS charge, count(*) AS n, count(DISTINCT o_custkey) AS peptides, round(count(*) FILTER (o_orderkey % 2 = 0) * 73.01::DOUBLE, 2) AS added, max(o_orderkey)::INT AS last FROM orders GROUP BY 1",
    "classified_reread": f"WITH {_CLS} SELECT \"group\", level, count(*) AS n, count(dm) AS n_mass, round(min(dm), 4) AS mass_min, round(max(dm), 4) AS mass_max, round(avg(dm), 4) AS mass_mean FROM c GROUP BY 1, 2",
    "result_json": f"WITH {_PSMS} SELECT count(*) AS psms, count(*) FILTER (q_value <= 0.01) AS psms_at_q, count(DISTINCT CASE WHEN q_value <= 0.01 THEN peptide END) AS peptides_at_q, count(DISTINCT CASE WHEN q_value <= 0.01 THEN accession END) AS proteins_at_q, round(median(CASE WHEN q_value <= 0.01 THEN score END), 6) AS median_score, round(median(CASE WHEN q_value <= 0.01 THEN delta_ppm END), 6) AS median_delta_ppm FROM p",
    "file_digests": "WITH t AS (SELECT string_agg(s_name, chr(10) ORDER BY s_name) || chr(10) AS t FROM supplier) SELECT len(t)::BIGINT AS length, sha256(t) AS sha256 FROM t",
    "run_metadata": f"WITH {_CLS} SELECT \"group\", level, count(*) AS n, 1::INT AS inputs, '{{\"missed\": 2}}' AS settings FROM c GROUP BY 1, 2",
    "validation": """WITH l AS (SELECT *, l_orderkey % 10 AS n FROM lineitem) SELECT concat_ws(',', CASE WHEN l_linenumber < 2 THEN 'scan' END, CASE WHEN n = 1 THEN 'peptide' END, CASE WHEN n % 5 = 0 THEN 'charge' END, CASE WHEN n IN (2, 3) OR l_quantity <= 0 THEN 'precursor_mz' END, CASE WHEN l_quantity <= 0 THEN 'calculated_mz' END, CASE WHEN n = 4 THEN 'delta_ppm' END, CASE WHEN n = 6 THEN 'q_value' END, CASE WHEN n = 8 THEN 'accessions' END) AS violations, count(*) AS n FROM l GROUP BY 1""",
    "validation_proteins": "SELECT concat_ws(',', CASE WHEN p_size = 1 THEN 'accession' END, CASE WHEN p_size > 40 THEN 'coverage' END, CASE WHEN p_partkey % 5 > p_size % 5 THEN 'unique' END) AS violations, count(*) AS n FROM part GROUP BY 1",
    "validation_groups": "SELECT concat_ws(',', CASE WHEN p_size = 1 THEN 'leader' END, CASE WHEN p_size = 1 THEN 'leader_in_members' END, CASE WHEN p_size > 40 THEN 'coverage' END) AS violations, count(*) AS n FROM part GROUP BY 1",
    "run_names": """WITH n AS (SELECT ['', '../', 'a\\', 'x.', '/'][p_partkey % 5 + 1] || CASE p_size % 3 WHEN 0 THEN '.' WHEN 1 THEN '' ELSE p_name END AS n FROM part) SELECT n NOT IN ('', '.', '..') AND NOT contains(n, '/') AND NOT contains(n, '\\') AS bare, count(*) AS n FROM n GROUP BY 1""",
    "search_matches": f"{_FOUND} SELECT run, peptide, is_decoy, matched, total, CASE WHEN (SELECT bool_or(is_decoy) FROM r) THEN round(q_value, 9) END AS q_value FROM qd",
    "search_da": f"WITH {_CAND.format('abs(pmz - (mass + 2 * 1.007276::DOUBLE) / 2) <= 0.5')} SELECT run, count(*) AS candidates, round(max(abs(pmz - cmz)), 5) AS widest FROM near GROUP BY 1",
    "tool_search": f"{_FOUND} SELECT count(*) AS psms, count(*) FILTER (q_value <= 0.01) AS psms_at_q, count(DISTINCT CASE WHEN q_value <= 0.01 THEN peptide END) AS peptides_at_q FROM qd WHERE NOT is_decoy",
    "tool_export": f"{_FOUND} SELECT peptide AS sequence, count(*) AS psm_count, true AS has_q FROM qd WHERE NOT is_decoy GROUP BY 1",
    "tool_read_spectra": f"WITH {_S} SELECT count(*) AS spectra, count(*) AS ms2, min(lo) AS mz_min, max(hi) AS mz_max, min(rt_min) AS rt_from, max(rt_min) AS rt_to FROM s WHERE ms_level = 2",
    "tool_get_spectrum": f"WITH {_S}, m AS (SELECT max(run::INT * 100 + scan)::INT AS scan FROM s) SELECT m.scan, mz, i AS intensity FROM e JOIN m ON run::INT * 100 + e.scan = m.scan",
    "tool_find_by_time": f"WITH {_T} SELECT id, scan, round(dist::DOUBLE, 6) AS distance FROM (SELECT id, scan, abs(rt - ort) AS dist, row_number() OVER (PARTITION BY id ORDER BY abs(rt - ort), rt, scan) AS r FROM o JOIN t ON o_custkey = user_id AND abs(rt - ort) <= 100 AND hm BETWEEN value - k AND value + k) WHERE r = 1",
    "tool_classify": f"WITH {_CLASSES} SELECT 'trap' AS \"group\", level, count(*) AS n, round(avg(CASE WHEN level IN ('L2', 'L3') THEN b.dm WHEN level IN ('L0', 'L1') THEN 0 END), 4) AS mass_mean FROM ps JOIN lv ON lv.p = ps.p GROUP BY 1, 2",
    "engine_features": "WITH r AS (SELECT *, l_linenumber % 4 AS z FROM lineitem WHERE l_linenumber % 4 > 0), m AS (SELECT *, (l_extendedprice + 0.01 + z * 1.007276) / z AS c, (l_extendedprice + z * 1.007276) / z AS p FROM r) SELECT z::INT AS charge, l_returnflag = 'R' AS is_decoy, count(*) AS n, min(CASE WHEN l_linenumber = 7 THEN 1 ELSE l_orderkey END)::INT AS least_scan, round(sum(c), 3) AS mz, round(min((p - c) / c * 1e6), 3) AS least_ppm, round(max(l_tax), 3) AS most_next FROM m GROUP BY 1, 2",
    "rescored_peptides": "WITH t AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R'), a AS (SELECT l_partkey, array_to_string(list_sort(list_distinct(list_concat(list(l_suppkey::VARCHAR), list((l_suppkey % 7)::VARCHAR)))), ';') AS accessions FROM t GROUP BY 1) SELECT l_partkey::VARCHAR AS peptide, max(l_extendedprice) AS best_score, arg_min(l_discount, struct_pack(s := -l_extendedprice, q := l_discount)) AS q_value, any_value(accessions) AS accessions, count(*) AS psm_count FROM t JOIN a USING (l_partkey) GROUP BY l_partkey",
    "rescored_proteins": "WITH t AS (SELECT DISTINCT l_partkey, unnest([l_suppkey::VARCHAR, (l_suppkey % 7)::VARCHAR]) AS accession FROM lineitem WHERE l_returnflag <> 'R'), o AS (SELECT l_partkey, count(*) AS k FROM t GROUP BY 1) SELECT accession, count(*) AS peptide_count, count(*) FILTER (k = 1) AS unique_peptide_count FROM t JOIN o USING (l_partkey) GROUP BY 1",
    "extraction_statistics": f"WITH {_S}, z AS (SELECT run, scan % 4 + 1 AS z, count(*) AS n FROM s WHERE ms_level = 2 GROUP BY 1, 2), c AS (SELECT run, string_agg(z || ':' || n, ',' ORDER BY z) AS charges FROM z GROUP BY 1) SELECT run, count(*) AS ms2, count(*) AS precursors, 1.0 AS per_ms2, any_value(charges) AS charges FROM s JOIN c USING (run) WHERE ms_level = 2 GROUP BY run",
    "heavy_annotation": f"WITH {_CAND.format('false')}, {_MADE}, heavy AS (SELECT run, n, 'b' AS kind, mz + {_mass('run[1:n]', chem.SILAC)} AS mz FROM (SELECT run, n, {_mass('run[1:n]')} + 1.007276::DOUBLE AS mz FROM si) UNION ALL SELECT run, n, 'y', mz + {_mass('run[len(run) - n + 1:]', chem.SILAC)} FROM (SELECT run, n, {_mass('run[len(run) - n + 1:]')} + 18.010565::DOUBLE + 1.007276::DOUBLE AS mz FROM si)) SELECT run, count(*) AS ions, count(*) FILTER (EXISTS (SELECT 1 FROM peak WHERE peak.run = heavy.run AND abs(pk - mz) <= mz * 20e-6)) AS matched FROM heavy GROUP BY 1",
    "substituted_mods": "WITH p AS (SELECT p_partkey, p_size % 8 AS k, upper(p_name) AS a, upper(translate(p_name, 'aeiou', 'AEuio')) AS b FROM part) SELECT p_partkey, CASE WHEN a[2] <> b[2] THEN 10 ELSE 0 END + CASE WHEN a[k + 1] <> b[k + 1] THEN 1.5::DOUBLE ELSE 0 END AS mass FROM p",
    "group_coverage": f"WITH c AS ({_COVERED}) SELECT accession AS leader, round(covered / len, 6) AS coverage FROM c",
}
SQL["traced_provenance"] = f"""WITH {_CAND.format("false")}, pep AS (SELECT run AS peptide FROM sp WHERE len(run) % 3 > 0 AND 2 * ((len(run) - 1) // 2) >= 8), made_i AS (SELECT peptide, unnest(range(2, len(peptide), 2)) AS n FROM pep),
peak AS (SELECT peptide, {_mass("peptide[1:n]")} + 1.007276::DOUBLE AS pmz, n::DOUBLE AS height FROM made_i UNION ALL SELECT peptide, {_mass("peptide[len(peptide) - n + 1:]")} + 18.010565::DOUBLE + 1.007276::DOUBLE, n::DOUBLE FROM made_i), {_ion_tables("own", "peptide")}, {_ion_tables("rev", _REVERSED)},
c AS (SELECT peptide, pmz, pmz IN (SELECT h.p.m FROM own_h h WHERE h.peptide = peak.peptide) AS t, pmz IN (SELECT h.p.m FROM rev_h h WHERE h.peptide = peak.peptide) AS o FROM peak), n AS (SELECT peptide AS id, {_COUNTS} FROM c GROUP BY 1) SELECT *, {_SHARE} FROM n"""
