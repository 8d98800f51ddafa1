"""Exports: tab-separated tables, JSON, run metadata, history, pages."""

from __future__ import annotations

import html
import json
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massq.functions.exprs import sanitize_tsv

#: Columns of the classified table, in order.
CLASSIFIED = ("peptide", "charge", "precursor_mz", "retention_time", "scan_number", "spectrum_file", "protein_ids", "q_value", "group", "level", "best_target_peptide", "best_target_protein", "mismatches", "delta_mass_da", "diff_positions", "substitution_type", "edit_distance", "alignment_detail", "trap_matched", "target_matched", "shared_ions", "shared_ratio", "is_chimeric")
HISTORY_MOST = 500


def _fixed(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double"))


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, sanitize_tsv), ";")


def _q() -> Column:
    return F.when(F.col("q_value").isNull(), "NA").otherwise(_fixed("q_value", 6))


def psm_lines(psms: DataFrame) -> DataFrame:
    """The match table as text columns with fixed precisions."""
    return psms.select(F.col("scan").cast("string").alias("scan"), sanitize_tsv(F.col("peptide")).alias("sequence"), F.col("charge").cast("string").alias("charge"), _fixed("precursor_mz", 8).alias("precursor_mz"), _fixed("calculated_mz", 8).alias("calculated_mz"), _fixed("delta_ppm", 2).alias("delta_ppm"), _fixed("score", 6).alias("score"), _q().alias("q_value"), _joined("accessions").alias("proteins"), F.col("is_decoy").cast("string").alias("is_decoy"), _joined("modifications").alias("modifications"))


def peptide_lines(peptides: DataFrame) -> DataFrame:
    return peptides.select(sanitize_tsv(F.col("peptide")).alias("sequence"), _joined("accessions").alias("proteins"), _fixed("best_score", 6).alias("best_score"), _q().alias("q_value"), F.col("psm_count").cast("string").alias("psm_count"))


def protein_lines(proteins: DataFrame) -> DataFrame:
    return proteins.select(sanitize_tsv(F.col("accession")).alias("accession"), sanitize_tsv(F.col("description")).alias("description"), _fixed("coverage", 4).alias("coverage"), F.col("peptide_count").cast("string").alias("peptide_count"), F.col("unique_peptide_count").cast("string").alias("unique_peptide_count"))


def write_tsv(lines: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated with a header, null as nothing. Parts are written in parallel; one file only if asked for."""
    (lines.coalesce(1) if single else lines).write.csv(path, sep="\t", header=True, nullValue="", emptyValue="", quote="")


def classified_lines(classified: DataFrame) -> DataFrame:
    """All 23 columns, those that are missing blank."""
    have = set(classified.columns)
    return classified.select(*[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in CLASSIFIED])


def razor_errors(classified: DataFrame) -> DataFrame:
    """Traps that are exact target peptides."""
    rows = classified.where((F.col("group") == "trap") & (F.col("level") == "L0"))
    return rows.select("peptide", F.col("protein_ids").alias("current_protein"), F.col("best_target_protein").alias("suggested_target_protein"), F.lit("exact target peptide assigned to a trap protein").alias("reason"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of input files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def run_metadata(classified: DataFrame, inputs: DataFrame, settings: dict) -> DataFrame:
    """One row about a run: its settings, its inputs' digests, and matches by group and level."""
    levels = classified.groupBy("group", "level").agg(F.count(F.lit(1)).alias("n"))
    counts = levels.agg(F.array_sort(F.collect_list(F.struct("group", "level", "n"))).alias("levels"))  # a few groups and levels
    files = inputs.agg(F.array_sort(F.collect_list(F.struct("path", "length", "sha256"))).alias("inputs"))
    return counts.crossJoin(files).withColumn("settings", F.lit(json.dumps(settings, sort_keys=True, default=str)))  # two rows


def chimeric(counts: DataFrame, most: float = 0.30) -> DataFrame:
    """Rows of ``trace_multi_target``, marked where more than a share of all peaks are shared, light and heavy together."""
    from massq.operators.multitarget import chimeric_share

    return chimeric_share(counts).withColumn("is_chimeric", F.col("shared_ratio") > most)


def multi_target_page(title: str, counts: DataFrame, most: int = 10_000) -> str:
    """The summary of multi-target provenance, most shared first."""
    return page(title, chimeric(counts).orderBy(F.desc("shared_ratio"), *[c for c in ("run", "scan") if c in counts.columns]), most)


def save_history(entry: dict, folder: str) -> str:
    """One JSON file a run on the driver; beyond 500 the oldest go."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    entry = {"run_id": uuid.uuid4().hex, "timestamp": time.time_ns()} | entry
    Path(folder, f"{entry['timestamp']:020d}-{entry['run_id']}.json").write_text(json.dumps(entry))
    for old in sorted(Path(folder).glob("*.json"))[:-HISTORY_MOST]:
        old.unlink()
    return entry["run_id"]


def load_history(spark: SparkSession, folder: str, status: str = "", limit: int = 20) -> DataFrame:
    """Newest first, by the start of the status; files that can't be read are skipped."""
    df = spark.read.schema("run_id string, timestamp long, status string, engine string, psms long").json(folder, mode="DROPMALFORMED")
    return df.where("run_id is not null").where(F.coalesce("status", F.lit("")).startswith(status)).orderBy(F.desc("timestamp"), "run_id").limit(limit)


def page(title: str, data, most: int = 10_000) -> str:
    """An HTML page with its data as JSON inside. For frames only as many rows as a page shows; the rest is in the tables."""
    rows = [r.asDict(True) for r in data.limit(most).collect()] if isinstance(data, DataFrame) else data
    text = json.dumps(rows, default=str).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    head = html.escape(title)
    script = "const d=JSON.parse(document.getElementById('data').textContent),t=document.getElementById('t');if(d.length){const k=Object.keys(d[0]);const row=(x,c)=>{const r=t.insertRow();x.forEach(v=>{const e=document.createElement(c);e.textContent=v===null?'':typeof v==='object'?JSON.stringify(v):v;r.append(e)})};row(k,'th');d.forEach(o=>row(k.map(c=>o[c]),'td'))}"
    return f'<!doctype html><meta charset="utf-8"><title>{head}</title><h1>{head}</h1><table id="t"></table><script id="data" type="application/json">{text}</script><script>{script}</script>'


def mirror_page(title: str, upper: DataFrame, lower: DataFrame) -> str:
    """Two annotated spectra, one above the axis and one below it."""
    side = lambda d, sign: [[r.mz, sign * r.intensity, r.label] for r in d.select("mz", "intensity", "label").limit(10_000).collect()]
    points = side(upper, 1) + side(lower, -1)
    top_mz, top = max((p[0] for p in points), default=1.0) or 1.0, max((abs(p[1]) for p in points), default=1.0) or 1.0
    lines = "".join(f'<line x1="{980 * m / top_mz:.1f}" x2="{980 * m / top_mz:.1f}" y1="200" y2="{200 - 190 * i / top:.1f}" stroke="{"#357" if i > 0 else "#a43"}"><title>{html.escape(str(name or ""))} {m:.4f}</title></line>' for m, i, name in points)
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><svg viewBox="0 0 1000 400" width="1000"><line x1="0" x2="1000" y1="200" y2="200" stroke="#000"/>{lines}</svg>'
