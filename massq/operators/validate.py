"""Rules that results must keep, as columns: each function adds an array of the names of broken ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(c: str) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def _unit(c: str) -> Column:
    """Null, or from 0 to 1."""
    return F.col(c).isNull() | (~F.isnan(c) & F.col(c).between(0.0, 1.0))


def _named(c: str) -> Column:
    return F.trim(c) != ""


def broken(rows: DataFrame, rules: dict[str, Column], out: str = "violations") -> DataFrame:
    """``rows`` with the names of rules that don't hold, in the order given; a null counts as broken."""
    return rows.withColumn(out, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def matches(psms: DataFrame) -> DataFrame:
    positive = {c: _finite(c) & (F.col(c) > 0) for c in ("precursor_mz", "calculated_mz")}
    return broken(psms, {"scan": F.col("scan") >= 1, "peptide": _named("peptide"), "charge": F.col("charge") != 0, **positive, "delta_ppm": _finite("delta_ppm"), "score": _finite("score"), "q_value": _unit("q_value"), "accessions": F.size("accessions") > 0})


def peptides(rows: DataFrame) -> DataFrame:
    return broken(rows, {"peptide": _named("peptide"), "accessions": F.size("accessions") > 0, "best_score": _finite("best_score"), "q_value": _unit("q_value")})


def proteins(rows: DataFrame) -> DataFrame:
    return broken(rows, {"accession": _named("accession"), "coverage": F.col("coverage").isNotNull() & _unit("coverage"), "unique": F.col("unique_peptide_count") <= F.col("peptide_count")})


def summaries(rows: DataFrame) -> DataFrame:
    """(psms, psms_at_q, peptides_at_q, median_score, median_delta_ppm, identification_rate, seconds)."""
    rules = {c: _finite(c) for c in ("median_score", "median_delta_ppm")}
    return broken(rows, {**rules, "identification_rate": F.col("identification_rate").isNotNull() & _unit("identification_rate"), "seconds": _finite("seconds") & (F.col("seconds") >= 0), "psms_at_q": F.col("psms_at_q") <= F.col("psms"), "peptides_at_q": F.col("peptides_at_q") <= F.col("psms_at_q")})


def groups(rows: DataFrame) -> DataFrame:
    return broken(rows, {"leader": _named("leader"), "members": F.size("members") > 0, "leader_in_members": F.array_contains("members", F.col("leader")), "peptides": F.size("peptides") > 0, "coverage": _unit("coverage"), "q_value": _unit("q_value")})


def run_metadata(rows: DataFrame) -> DataFrame:
    """(engine, engine_version, input_files, seconds, precursor_tolerance, fragment_tolerance, missed, max_mods, shortest, longest): seconds may be null, parameters keep to ``advice.Params``."""
    positive = {c: _finite(c) & (F.col(c) > 0) for c in ("precursor_tolerance", "fragment_tolerance")}
    rules = {"seconds": F.col("seconds").isNull() | (_finite("seconds") & (F.col("seconds") >= 0)), "input_files": F.size("input_files") > 0, "engine": _named("engine"), "engine_version": _named("engine_version")}
    return broken(rows, {**rules, **positive, "missed": F.col("missed").between(0, 5), "max_mods": F.col("max_mods").between(0, 10), "lengths": (F.col("shortest") >= 1) & (F.col("shortest") <= F.col("longest"))})


def decisions(rows: DataFrame) -> DataFrame:
    """(confidence, explanation, input_summary): a confidence from 0 to 1, and words on why and from what."""
    return broken(rows, {"confidence": F.col("confidence").isNotNull() & _unit("confidence"), "explanation": _named("explanation"), "input_summary": _named("input_summary")})


def bare_name(name: Column) -> Column:
    """Whether a run's name is a bare file name, so that joining it to a folder can't leave the folder."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\]"), F.lit(False))
