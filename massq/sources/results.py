"""Search results of other tools as matches, the Unimod dictionary, lists of annotations."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massq.functions.chem import mh_to_mz
from massq.operators.validate import bare_name

# Unimod id, title, mass, residues (none: any), as imports resolve them.
UNIMOD = (
    (1, "Acetyl", 42.010565, ""), (4, "Carbamidomethyl", 57.021464, "C"), (5, "Carbamyl", 43.005814, ""), (7, "Deamidated", 0.984016, "NQ"),
    (21, "Phospho", 79.966331, "STY"), (27, "Glu->pyro-Glu", -18.010565, "E"), (28, "Gln->pyro-Glu", -17.026549, "Q"), (34, "Methyl", 14.015650, ""),
    (35, "Oxidation", 15.994915, "MWH"), (36, "Dimethyl", 28.031300, ""), (37, "Trimethyl", 42.046950, ""), (39, "Dehydrated", -18.010565, ""),
    (40, "Formyl", 27.994915, ""), (121, "GlyGly", 114.042927, "K"), (188, "Label:13C(6)", 6.020129, "KR"), (199, "Label:13C(6)15N(2)", 8.014199, "K"),
    (214, "Label:2H(4)", 4.025107, ""), (259, "Label:13C(6)15N(4)", 10.008269, "R"), (267, "Label:13C(6)15N(1)", 7.017165, ""), (268, "iTRAQ4plex", 144.102063, ""),
    (737, "TMT6plex", 229.162932, ""), (738, "TMTpro", 304.207146, ""),
)
#: Masses that entrapment analysis uses for the same ids; three differ from those above.
ENTRAPMENT_UNIMOD = {1: 42.010565, 4: 57.021464, 5: 43.005814, 7: 0.984016, 21: 79.966331, 27: -18.010565, 28: -17.026549, 34: 14.015650, 35: 15.994915, 121: 114.042927, 214: 229.162932, 259: 8.014199, 267: 10.008269}
TITLES = {title: mass for _, title, mass, _ in UNIMOD}
PFIND_COLUMNS = ("PeptideSequence", "CleavageType", "ProNCTerm")
MATCH = "peptide string, charge int, precursor_mz double, rt_min double, score double, q_value double, run string, scan int, accessions array<string>, modified string"


class ResultImportError(ValueError):
    """A result file that can't be read as asked."""


_MOD, _MOD_END, _PREFIX = re.compile(r"<(?:[\w.-]+:)?mod[\s/>]"), re.compile(r"</(?:[\w.-]+:)?$"), re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")


def _entries(piece: str) -> list[tuple]:
    """Entries of a piece of a dictionary that ended with ``mod>``: from its first opening tag on it is XML but for the names of its prefixes."""
    begin = _MOD.search(piece)
    if not begin or not _MOD_END.search(piece):
        return []
    names = " ".join(f'xmlns:{x}="{x}"' for x in sorted(set(_PREFIX.findall(piece)) - {"xml", "xmlns"}))
    found = []
    for m in (e for e in ET.fromstring(f"<part {names}>{piece[begin.start() :]}mod></part>").iter() if e.tag.split("}")[-1] == "mod"):
        delta = next((e for e in m if e.tag.split("}")[-1] == "delta"), None)
        letters = "".join(sorted({e.get("site", "") for e in m if e.tag.split("}")[-1] == "specificity" and len(e.get("site", "")) == 1}))
        if delta is not None:
            found.append((int(m.get("record_id")), m.get("title"), float(delta.get("mono_mass")), letters))
    return found


def unimod(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, title, mass, residues): the built-in ones, or those of Unimod XML, a file or a folder of them.

    A file is read as records that end where an entry ends, so tasks share it and the driver sees none.
    """
    schema = "id int, title string, mass double, residues string"
    if not path:
        return spark.createDataFrame(list(UNIMOD), schema)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for piece in batch["value"] for x in _entries(piece)], columns=["id", "title", "mass", "residues"])

    return spark.read.option("lineSep", "mod>").text(path).select("value").mapInPandas(parse, schema)


def detect_format(path: str, header: str | None = None) -> str:
    """By extension; a table counts as pFind if its header holds the three marker names."""
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix in ("json", "parquet", "spectra"):
        return suffix
    if suffix in ("tsv", "txt"):
        return "pfind_tsv" if header is not None and all(c in header for c in PFIND_COLUMNS) else "generic_tsv"
    raise ResultImportError(f"unknown result format: {path}")


def format_of(path: Column) -> Column:
    """``detect_format`` for a column of paths, without a look inside; null for unknown ones."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("json", "parquet", "spectra"), suffix).when(suffix.isin("tsv", "txt"), "generic_tsv")


def strip_modified(modified: Column) -> Column:
    """A modified sequence without parentheses (one level), brackets and underscores."""
    return F.regexp_replace(modified, r"\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\]]*\]|_", "")


def modifications(modified: Column, base: int = 1, masses: dict[int, float] | None = None) -> Column:
    """(pos, unimod, mass) of ``(UniMod:n)`` tags. Imports count residues from 1 with 0 for the N terminus;
    entrapment analysis (``base`` 0) counts from 0, and the N terminus is 0 too."""
    masses = masses or {k: m for k, _, m, _ in UNIMOD}
    table = F.create_map(*[x for k, m in masses.items() for x in (F.lit(k), F.lit(m))])
    # Text up to each tag: its letters tell the residue that it follows.
    tags = F.regexp_extract_all(modified, F.lit(r"(?i)\(unimod:(\d+)\)"), 1)
    parts = F.split(modified, r"(?i)\(unimod:\d+\)")
    letters = F.transform(parts, lambda p: F.length(strip_modified(p)))
    upto = lambda i: F.aggregate(F.slice(letters, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)
    at = lambda i: upto(i) if base else F.greatest(upto(i) - 1, F.lit(0))
    return F.transform(tags, lambda t, i: F.struct(at(i).alias("pos"), t.cast("int").alias("unimod"), F.coalesce(F.try_element_at(table, t.cast("int")), F.lit(0.0)).alias("mass")))


def _need(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ResultImportError(f"missing columns: {', '.join(missing)}")


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"`{name}`").try_cast(kind) if name in df.columns else F.lit(None).cast(kind)


def read_diann(spark: SparkSession, path: str, q: float = 0.01, run: str | None = None) -> DataFrame:
    """A DIA-NN report for import: rows over the q-value, of other runs or without a value go; filters reach the Parquet scan."""
    df = spark.read.parquet(path)
    _need(df, "Modified.Sequence", "Precursor.Charge", "Precursor.Mz", "RT", "Q.Value", "Run")
    c = lambda n: F.col(f"`{n}`")
    rows = df.where((c("Q.Value") <= q) & c("Modified.Sequence").isNotNull() & (c("Precursor.Charge") > 0) & c("Precursor.Mz").isNotNull() & c("RT").isNotNull() & c("Run").isNotNull())
    rows = rows if run is None else rows.where(c("Run") == run)
    names = F.split(F.coalesce(_or_null(df, "Protein.Names", "string"), F.lit("")), ";")
    return rows.select(strip_modified(c("Modified.Sequence")).alias("peptide"), c("Precursor.Charge").cast("int").alias("charge"), c("Precursor.Mz").cast("double").alias("precursor_mz"), c("RT").cast("double").alias("rt_min"), (1 - c("Q.Value")).cast("double").alias("score"), c("Q.Value").cast("double").alias("q_value"), c("Run").alias("run"), F.lit(None).cast("int").alias("scan"), F.filter(names, lambda x: x != "").alias("accessions"), c("Modified.Sequence").alias("modified"))


def read_diann_entrapment(spark: SparkSession, path: str) -> DataFrame:
    """A DIA-NN report for entrapment analysis: only sequence and proteins are required, nothing is filtered."""
    df = spark.read.parquet(path)
    _need(df, "Stripped.Sequence", "Protein.Ids")
    optional = (("Precursor.Charge", "int", "charge"), ("Precursor.Mz", "double", "precursor_mz"), ("RT", "double", "rt_min"), ("RT.Start", "double", "rt_start"), ("RT.Stop", "double", "rt_stop"), ("Q.Value", "double", "q_value"), ("Run", "string", "run"), ("Modified.Sequence", "string", "modified"))
    return df.select(F.col("`Stripped.Sequence`").alias("peptide"), F.col("`Protein.Ids`").alias("protein_ids"), *[_or_null(df, n, k).alias(a) for n, k, a in optional])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of {sequence, charge, modify [[pos, unimod]], rt, precursor_mz, raw_title, protein_names}."""
    schema = "sequence string, charge int, modify array<array<int>>, rt double, precursor_mz double, raw_title string, protein_names array<string>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select(F.col("sequence").alias("peptide"), "charge", "precursor_mz", F.col("rt").alias("rt_min"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("q_value"), F.col("raw_title").alias("run"), F.lit(None).cast("int").alias("scan"), F.coalesce("protein_names", F.array().cast("array<string>")).alias("accessions"), F.to_json("modify").alias("modified"))


def pfind_modifications(text: Column) -> Column:
    """(pos, name, mass) of ``3,Oxidation[M];``-like lists; unknown names weigh 0."""
    table = F.create_map(*[x for t, m in TITLES.items() for x in (F.lit(t), F.lit(m))])
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda p: p.rlike(r"^\d+,"))
    name = lambda p: F.regexp_extract(p, r"^\d+,([^\[]+)", 1)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+),", 1).cast("int").alias("pos"), name(p).alias("name"), F.coalesce(F.try_element_at(table, name(p)), F.lit(0.0)).alias("mass")))


def _tsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, quote="")


def read_pfind(spark: SparkSession, path: str) -> DataFrame:
    """pFind results for import: numbers that can't be read are 0, rows without a positive charge go."""
    df = _tsv(spark, path)
    _need(df, "FileName", "PeptideSequence", "Modifications", "PredRT", "Proteins", "MH+", "Charge", "ScanNo", "FinalScore", "QValue", "DeltaRT(Min)")
    number = lambda n, kind="double": F.coalesce(F.col(f"`{n}`").try_cast(kind), F.lit(0).cast(kind))
    rows = df.where(number("Charge", "int") > 0)
    proteins = F.filter(F.split(F.coalesce("Proteins", F.lit("")), "/"), lambda x: F.trim(x) != "")
    return rows.select(F.col("PeptideSequence").alias("peptide"), number("Charge", "int").alias("charge"), mh_to_mz(number("MH+"), number("Charge", "int")).alias("precursor_mz"), number("PredRT").alias("rt_min"), number("FinalScore").alias("score"), number("QValue").alias("q_value"), F.col("FileName").alias("run"), number("ScanNo", "int").alias("scan"), proteins.alias("accessions"), F.col("Modifications").alias("modified"))


def read_pfind_entrapment(spark: SparkSession, path: str) -> DataFrame:
    """pFind results for entrapment analysis: only the sequence is required, what can't be read is null."""
    df = _tsv(spark, path)
    _need(df, "PeptideSequence")
    proteins = F.array_join(F.filter(F.split(_or_null(df, "Proteins", "string"), "/"), lambda x: F.trim(x) != ""), ";")
    return df.select(F.col("PeptideSequence").alias("peptide"), proteins.alias("protein_ids"), _or_null(df, "Charge", "int").alias("charge"), mh_to_mz(_or_null(df, "MH+", "double"), _or_null(df, "Charge", "int")).alias("precursor_mz"), _or_null(df, "PredRT", "double").alias("rt_min"), _or_null(df, "ScanNo", "int").alias("scan"), _or_null(df, "QValue", "double").alias("q_value"), _or_null(df, "FileName", "string").alias("run"), _or_null(df, "Modifications", "string").alias("modified"))


GENERIC = {"peptide": "peptide", "charge": "charge", "precursor_mz": "precursor_mz", "rt_min": "retention_time", "scan": "scan_number", "run": "spectrum_file", "protein_ids": "protein_ids", "q_value": "q_value"}


def read_generic(spark: SparkSession, path: str, columns: dict[str, str] | None = None, delimiter: str = "\t") -> DataFrame:
    """Any table with a peptide column; other columns by the names given, blank peptides go."""
    names = GENERIC | (columns or {})
    df = _tsv(spark, path, delimiter)
    _need(df, names["peptide"])
    kinds = {"charge": "int", "precursor_mz": "double", "rt_min": "double", "scan": "int", "q_value": "double"}
    return df.select(*[_or_null(df, n, kinds.get(a, "string")).alias(a) for a, n in names.items()]).where(F.trim("peptide") != "")


def load_psms(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """For entrapment analysis, by extension and header."""
    if path.lower().endswith(".parquet"):
        return read_diann_entrapment(spark, path)
    header = spark.read.text(path).limit(1).collect()
    if header and all(c in header[0].value.split("\t") for c in PFIND_COLUMNS):
        return read_pfind_entrapment(spark, path)
    return read_generic(spark, path, columns)


#: Importers by format: functions of (spark, path, q, run). More may be added.
IMPORTERS = {"parquet": read_diann, "json": lambda spark, path, q, run: read_json(spark, path), "pfind_tsv": lambda spark, path, q, run: read_pfind(spark, path)}


def import_results(spark: SparkSession, path: str, q: float = 0.01, run: str | None = None) -> DataFrame:
    kind = detect_format(path, (spark.read.text(path).limit(1).collect() or [None])[0] and spark.read.text(path).first().value if re.search(r"\.(tsv|txt)$", path.lower()) else None)
    if kind == "spectra":
        raise NotImplementedError(".spectra files aren't supported")
    if kind not in IMPORTERS:
        raise ResultImportError(f"no importer for {kind}")
    rows = IMPORTERS[kind](spark, path, q, run)
    return rows.where(F.when(bare_name(F.col("run")), True).otherwise(F.raise_error(F.concat(F.lit("not a bare run name: "), F.coalesce("run", F.lit("")))).cast("boolean")))


CLASSIFIED_KINDS = {"charge": "int", "precursor_mz": "double", "retention_time": "double", "scan_number": "int", "q_value": "double", "mismatches": "int", "delta_mass_da": "double", "edit_distance": "int", "trap_matched": "int", "target_matched": "int", "shared_ions": "int", "shared_ratio": "double", "is_chimeric": "boolean"}


def read_classified(spark: SparkSession, path: str) -> DataFrame:
    """The classified table as it was written, by its header; blanks and what can't be read are null."""
    df = _tsv(spark, path)
    _need(df, "peptide", "protein_ids", "group", "level")
    return df.select(*[F.nullif(F.col(c), F.lit("")).try_cast(CLASSIFIED_KINDS.get(c, "string")).alias(c) for c in df.columns]).withColumn("delta_mass", _or_null(df, "delta_mass_da", "double"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(scan, peptide, charge, modifications as ``pos:delta;...``); a header is found by itself, a bad row is an error."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "").where(~F.lower("value").rlike("^scan"))
    bad = F.raise_error(F.concat(F.lit("not an annotation: "), F.col("value")))
    number = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("int"), bad.cast("int"))
    mods = F.transform(F.filter(F.split(F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("")), ";"), lambda x: x != ""), lambda m: F.struct(F.split_part(m, F.lit(":"), F.lit(1)).cast("int").alias("pos"), F.split_part(m, F.lit(":"), F.lit(2)).cast("double").alias("delta")))
    return rows.select(number(1).alias("scan"), F.try_element_at(parts, F.lit(2)).alias("peptide"), number(3).alias("charge"), mods.alias("mods"))


def read_config(text: str):
    """An entrapment configuration from YAML: version 1 with target and trap rules."""
    import yaml

    from massq.operators.entrapment import Config, Rule

    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or raw.get("version") != 1:
        raise ResultImportError("the configuration's version must be 1")

    def rule(name: str) -> Rule:
        found = {"ids": (), "contains": (), "regex": None}
        for r in raw.get(name) or ():
            found["contains"] += tuple(r.get("contains", ()) if isinstance(r.get("contains"), list) else [r["contains"]] if "contains" in r else ())
            found["ids"] += tuple(r.get("ids", ()))
            found["regex"] = r.get("regex", found["regex"])
        return Rule(**found)

    s = raw.get("similarity") or {}
    return Config(rule("target"), rule("trap"), raw.get("conflict_resolution", "prefer_target"), raw.get("unmatched", "ignore"), s.get("max_mismatches", 2), s.get("len_tolerance", 2), s.get("delta_mass_threshold_da", s.get("delta_mz_threshold_da", 1.0)), s.get("max_missed_cleavages", 2))
