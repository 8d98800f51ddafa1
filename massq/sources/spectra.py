"""Spectrum files as DataFrames of ``operators.spectra.SCHEMA``.

MGF and mzML are read as text records that end where a spectrum ends, so Spark splits
one file over tasks and no task holds a file. PFB has no mark to split at but a list of
addresses, by which ``sources.pfb`` splits it. Converted once to Parquet by ``ingest``, sorted by run
and time, look-ups by scan or time prune row groups instead of needing an index file.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massq.operators.spectra import PRECURSOR, SCHEMA
from massq.sources import pfb
from massq.sources.pfb import SpectrumFormatError

FORMATS = {".mgf": "mgf", ".mzml": "mzml", ".pfb": "pfb"}
MOST_PEAKS = 500_000


def detect_format(path: str) -> str:
    """By extension, in any case."""
    suffix = re.search(r"\.[^./]+$", path.rstrip("/").lower())
    if not suffix or suffix[0] not in FORMATS:
        raise SpectrumFormatError(f"unknown spectrum format: {path}")
    return FORMATS[suffix[0]]


def format_of(path: Column) -> Column:
    """``detect_format`` for a column of paths; null for unknown ones."""
    suffix = F.regexp_extract(F.lower(path), r"(\.[^./]+)/*$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), suffix)


def _run(path_column: Column) -> Column:
    return F.regexp_extract(path_column, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """``BEGIN IONS`` blocks; PEPMASS is required; a block that was never closed ends at the next one.

    Scans without SCANS count from 1 in file order: blocks are counted by split of a file first, so
    peaks don't move and no file is ordered in one task.
    """
    text = spark.read.option("lineSep", "END IONS").text(path)
    pieces = text.select(_run(F.col("_metadata.file_path")).alias("run"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.split("value", "BEGIN IONS").alias("p"))
    blocks = pieces.select("run", "at", "id", F.posexplode("p").alias("k", "block")).where("k > 0")
    field = lambda name: F.regexp_extract("block", rf"(?m)^\s*{name}=(.*?)\s*$", 1)
    mass = F.split(F.trim(field("PEPMASS")), r"\s+")
    charge = F.regexp_extract(field("CHARGE"), r"^(\d+)([+-]?)$", 1).try_cast("int") * F.when(F.regexp_extract(field("CHARGE"), r"^(\d+)([+-]?)$", 2) == "-", -1).otherwise(1)
    peaks = F.transform(F.regexp_extract_all("block", F.lit(r"(?m)^\s*([0-9][0-9.eE+-]*)[ \t]+([0-9][0-9.eE+-]*)"), 0), lambda line: F.split(F.trim(line), r"\s+"))
    peaks = F.filter(F.transform(peaks, lambda p: F.struct(p[0].try_cast("double").alias("mz"), p[1].try_cast("double").alias("intensity"))), lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())
    rows = blocks.select("run", "at", "id", "k", field("SCANS").try_cast("int").alias("named"), mass[0].try_cast("double").alias("pm"), F.try_element_at(mass, F.lit(2)).try_cast("double").alias("pi"), F.when(charge != 0, charge).alias("z"), (field("RTINSECONDS").try_cast("double") / 60).alias("rt"), F.array_sort(peaks).alias("peaks"))
    rows = rows.where("pm is not null")
    # A split's blocks have rising ids, so their number within it needs no peaks; splits start at ``at``.
    light = rows.where("named is null").select("run", "at", "id", "k")
    offsets = light.groupBy("run", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("off", F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("run", "at").orderBy("id", "k"))
    numbered = light.withColumn("r", number).join(offsets, ["run", "at"]).select("id", "k", (F.col("r") + F.col("off")).cast("int").alias("ordinal"))
    rows = rows.where("named is not null").withColumn("scan", F.col("named")).unionByName(rows.where("named is null").join(numbered, ["id", "k"]).withColumn("scan", F.col("ordinal")).drop("ordinal"))
    precursor = F.struct(F.col("pm").alias("mz"), F.col("z").alias("charge"), F.col("pi").alias("intensity"), F.lit(None).alias("isolation"), F.lit(None).alias("source_scan")).cast(PRECURSOR)
    return rows.select("run", "scan", F.lit(2).alias("ms_level"), F.coalesce("rt", F.lit(0.0)).alias("rt_min"), F.array(precursor).alias("precursors"), F.col("peaks.mz").alias("mz"), F.col("peaks.intensity").alias("intensity"), F.lit("centroid").alias("representation"))


_CV = re.compile(r"<(?:cvParam)\b([^>]*)>")
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')


def _params(xml: str) -> dict[str, tuple[str, str]]:
    """Value and unit by accession."""
    found = {}
    for m in _CV.finditer(xml):
        a = dict(_ATTRIBUTE.findall(m[1]))
        found[a.get("accession", "")] = (a.get("value", ""), a.get("unitAccession", ""))
    return found


def _number(params: dict, accession: str, kind=float):
    try:
        return kind(float(params[accession][0]))
    except (KeyError, ValueError):
        return None


def _array(xml: str) -> tuple[str, np.ndarray] | None:
    p = _params(xml)
    name = "mz" if "MS:1000514" in p else "intensity" if "MS:1000515" in p else None
    body = re.search(r"<binary>\s*([^<]*?)\s*</binary>", xml)
    if name is None or body is None:
        return None
    raw = base64.b64decode(body[1])
    raw = zlib.decompress(raw) if "MS:1000574" in p else raw
    values = np.frombuffer(raw, "<f4" if "MS:1000521" in p else "<f8").astype(float)
    if len(values) > MOST_PEAKS:
        raise SpectrumFormatError(f"more than {MOST_PEAKS} peaks in a spectrum")
    return name, values


def picked(mz: np.ndarray, intensity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima of a profile with the apex of the parabola through three points."""
    if len(mz) < 3:
        return mz, intensity
    a, b, c = intensity[:-2], intensity[1:-1], intensity[2:]
    at = np.flatnonzero((b > a) & (b >= c)) + 1
    a, b, c = intensity[at - 1], intensity[at], intensity[at + 1]
    bend = a - 2 * b + c
    shift = np.divide(0.5 * (a - c), bend, out=np.zeros(len(at)), where=bend != 0)
    shift[np.abs(shift) > 0.5] = 0
    return mz[at] + shift * np.where(shift >= 0, mz[at + 1] - mz[at], mz[at] - mz[at - 1]), b


def parse_mzml_spectrum(xml: str) -> dict | None:
    """A ``<spectrum ...`` element up to its end tag."""
    start = xml.find("<spectrum ")
    if start < 0:
        return None
    xml = xml[start:]
    head = dict(_ATTRIBUTE.findall(xml[: xml.index(">")]))
    scan = re.search(r"scan=(\d+)", head.get("id", ""))
    cut = xml.find("<precursorList")
    own = _params(xml[: cut if cut >= 0 else len(xml)])
    rt, unit = own.get("MS:1000016", ("0", ""))
    precursors = []
    for part in re.findall(r"<precursor\b.*?</precursor>", xml, re.S):
        p = _params(part)
        source = re.search(r'spectrumRef="[^"]*scan=(\d+)', part)
        target = _number(p, "MS:1000827")
        isolation = None if target is None else {"target": target, "lower": _number(p, "MS:1000828") or 0.0, "upper": _number(p, "MS:1000829") or 0.0}
        mz = _number(p, "MS:1000744")
        precursors.append({"mz": mz if mz is not None else target or 0.0, "charge": _number(p, "MS:1000041", int), "intensity": _number(p, "MS:1000042"), "isolation": isolation, "source_scan": int(source[1]) if source else None})
    arrays = dict(x for x in map(_array, re.findall(r"<binaryDataArray\b.*?</binaryDataArray>", xml, re.S)) if x)
    mz, intensity = arrays.get("mz", np.empty(0)), arrays.get("intensity", np.empty(0))
    order = np.argsort(mz, kind="stable") if len(mz) == len(intensity) else slice(None)
    mz, intensity = mz[order], intensity[order]
    if "MS:1000128" in own:
        mz, intensity = picked(mz, intensity)
    return {
        "scan": int(scan[1]) if scan else int(head.get("index", -1)) + 1, "ms_level": _number(own, "MS:1000511", int) or 2, "rt_min": float(rt or 0) / (60 if unit == "UO:0000010" else 1),
        "precursors": precursors, "mz": mz, "intensity": intensity, "representation": "centroid",
    }


def read_mzml(spark: SparkSession, path: str, scan: int | None = None) -> DataFrame:
    """All spectra; with ``scan``, those that name another one in their id are left out before they are parsed."""
    text = spark.read.option("lineSep", "</spectrum>").text(path)
    chunks = text.where(F.col("value").contains("<spectrum ")).select(_run(F.col("_metadata.file_path")).alias("run"), "value")
    if scan is not None:
        head = F.regexp_extract("value", "<spectrum [^>]*", 0)
        chunks = chunks.where(~head.rlike(r'\bid="[^"]*scan=\d') | head.rlike(rf"scan=0*{int(scan)}(?!\d)"))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame([{"run": run, **s} for run, xml in zip(rows.run, rows.value, strict=True) if (s := parse_mzml_spectrum(xml))], columns=["run", "scan", "ms_level", "rt_min", "precursors", "mz", "intensity", "representation"])

    return chunks.mapInPandas(parse, SCHEMA)


def parse_pfb(content: bytes) -> Iterator[dict]:
    """Records of a whole PFB file, of which the header states where the addresses at its end begin."""
    _, count = pfb.header(content, len(content))
    at = pfb.HEADER
    for _ in range(count):
        row, at = pfb.record(content, at)
        yield row


def read_pfb(spark: SparkSession, path: str) -> DataFrame:
    """Ranges of records in parallel where the address can be opened (``sources.pfb``), else a file a task."""
    if pfb.splittable(spark, path):
        pfb.register(spark)
        return spark.read.format("pfb").load(path)
    return parse_pfb_table(spark.read.format("binaryFile").load(path).select(_run(F.col("path")).alias("run"), "content"))


def parse_pfb_table(files: DataFrame) -> DataFrame:
    """Spectra of (run, content) rows."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for run, content in zip(rows.run, rows.content, strict=True):
                yield pd.DataFrame([{"run": run, **s} for s in parse_pfb(content)], columns=["run", "scan", "ms_level", "rt_min", "precursors", "mz", "intensity", "representation"])

    return files.mapInPandas(parse, SCHEMA)


#: By format; more may be added, with their suffixes in FORMATS.
READERS = {"mgf": read_mgf, "mzml": read_mzml, "pfb": read_pfb}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return READERS[kind or detect_format(path)](spark, path)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of files of any formats; ``run`` tells equal scan numbers of different files apart."""
    out = read(spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(read(spark, p))
    return out


def read_scan(spark: SparkSession, path: str, scan: int) -> DataFrame:
    """At least the spectra of one scan number; mzML parses hardly any others."""
    return read_mzml(spark, path, scan) if detect_format(path) == "mzml" else read(spark, path)


def ingest(spectra: DataFrame, path: str) -> DataFrame:
    """Parquet by ranges of run and time, sorted within files: the form in which look-ups prune. A long run spreads over files."""
    spectra.repartitionByRange("run", "rt_min", "scan").sortWithinPartitions("run", "rt_min", "scan").write.mode("errorifexists").parquet(path)
    return spectra.sparkSession.read.schema(spectra.schema).parquet(path)
