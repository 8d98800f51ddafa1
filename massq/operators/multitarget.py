"""Provenance of trap matches against all targets that elute with them, light and heavy, as one plan.

Traps meet co-eluting targets, spectra are looked up by scan or by time, and every peak is held
against the ions of the trap and of all its candidates. All traps of all runs go through the same joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massq.functions.chem import SILAC, heavy_delta, heavy_mz, mz, peptide_mass, theoretical_ions
from massq.operators.entrapment import co_eluting
from massq.operators.joins import band_join, ppm_join
from massq.operators.shared import materialise
from massq.operators.spectra import by_level, dia_windows

COUNTS = ("trap_only", "target_only", "shared", "unassigned")


def scan_at(spectra: DataFrame, wanted: DataFrame, width: float = 1.0) -> DataFrame:
    """(id, scan): the MS2 nearest in time to each of ``wanted`` (id, run, at, mz, reach) within its own reach, whose window, if known, holds the m/z.

    Of equally near scans the earlier, then the one with the lower number.
    """
    iso = F.try_element_at("precursors", F.lit(1))["isolation"]
    scans = by_level(spectra, 2).select("run", "scan", F.col("rt_min").alias("_rt"), (iso["target"] - iso["lower"]).alias("_from"), (iso["target"] + iso["upper"]).alias("_to"))
    bands = wanted.select("id", "run", "at", F.col("mz").alias("_mz"), (F.col("at") - F.col("reach")).alias("_lo"), (F.col("at") + F.col("reach")).alias("_hi"))
    met = band_join(scans, bands, "_rt", "_lo", "_hi", width, ("run",)).where(F.col("_from").isNull() | F.col("_mz").between(F.col("_from"), F.col("_to")))
    return met.groupBy("id").agg(F.min(F.struct(F.abs(F.col("_rt") - F.col("at")).alias("d"), "_rt", "scan"))["scan"].alias("scan"))


def heavy_partners(spectra: DataFrame, annotated: DataFrame, reach: float = 0.5, ppm: float = 20.0, narrow: float = 1.0, label: dict[str, float] = SILAC) -> DataFrame:
    """(id, scan, heavy_mz): the scan that shows the heavy form of each of ``annotated`` (id, run, scan, peptide, charge), null for none.

    The nearest MS2 in time within ``reach`` minutes whose window holds the heavy precursor. If the light scan's window is
    ``narrow`` or less, the partner's own precursor has to lie under ``ppm`` from it as well.
    """
    first = F.try_element_at("precursors", F.lit(1))
    ms2 = by_level(spectra, 2).select("run", "scan", "rt_min", first["mz"].alias("_mz"), F.coalesce(first["isolation"]["lower"] + first["isolation"]["upper"], F.lit(0.0)).alias("_width"))
    light = annotated.join(ms2, ["run", "scan"]).where(heavy_delta(F.col("peptide"), label) != 0)
    wanted = light.select("id", "run", F.col("rt_min").alias("at"), heavy_mz(mz(peptide_mass(F.col("peptide")), F.col("charge")), F.col("peptide"), F.col("charge"), label).alias("mz"), F.lit(reach).alias("reach"), "_width")
    found = scan_at(spectra, wanted).join(wanted.select("id", "run", "mz", F.col("_width").alias("_light")), "id").join(ms2, ["run", "scan"])
    fits = (F.col("_light") > narrow) | (F.abs(F.col("_mz") - F.col("mz")) / F.col("mz") * 1e6 < ppm)
    return wanted.select("id", F.col("mz").alias("heavy_mz")).join(found.where(fits).select("id", "scan"), "id", "left").select("id", "scan", "heavy_mz")


def candidates(traps: DataFrame, targets: DataFrame, windows: DataFrame, label: dict[str, float] | None = SILAC, most: int = 20) -> DataFrame:
    """(id, candidate from 1, peptide, heavy): targets that elute with each trap in its window, each light and, where it has labelled residues, heavy next to it; ``most`` forms a trap."""
    mods = [F.col("o_mods").alias("mods")] if "mods" in targets.columns else []
    rows = co_eluting(traps, targets, windows, most).select(F.col("t_id").alias("id"), "rank", F.col("o_peptide").alias("peptide"), *mods)
    forms = F.array(F.lit(False)) if label is None else F.when(heavy_delta(F.col("peptide"), label) != 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("heavy", F.explode(forms))
    number = F.row_number().over(Window.partitionBy("id").orderBy("rank", "heavy"))
    return rows.withColumn("candidate", number).where(F.col("candidate") <= most).drop("rank")


def mirror(peaks: DataFrame, forms: DataFrame, tolerance: float = 20.0, max_charge: int = 2, label: dict[str, float] | None = SILAC) -> DataFrame:
    """(id, trap_only, target_only, shared, unassigned): whose ions explain each row's peaks.

    ``peaks``: (id, mz); ``forms``: (id, candidate: 0 for the trap, peptide, heavy, mods if any). A peak is
    explained by any ion within tolerance, by several forms at once.
    """
    mods = F.col("mods") if "mods" in forms.columns else None
    ions = lambda deltas: theoretical_ions(F.col("peptide"), deltas, max_charge, False, mods)
    chosen: Column = ions(None) if label is None else F.when(F.col("heavy"), ions(label)).otherwise(ions(None))
    theory = forms.select("id", "candidate", F.explode(F.transform(chosen, lambda i: i["mz"])).alias("ion_mz"))
    each = peaks.select("id", F.posexplode("mz").alias("peak", "mz"))
    claims = ppm_join(each, theory, "mz", "ion_mz", tolerance, ("id",)).groupBy("id", "peak").agg(F.max(F.col("candidate") == 0).alias("t"), F.max(F.col("candidate") > 0).alias("o"))
    rows = each.join(claims, ["id", "peak"], "left")
    t, o = F.coalesce("t", F.lit(False)), F.coalesce("o", F.lit(False))
    return rows.groupBy("id").agg(*[F.count_if(c).alias(n) for n, c in zip(COUNTS, (t & ~o, o & ~t, t & o, ~t & ~o), strict=True)])


def trace_multi_target(
    classified: DataFrame, matches: DataFrame, spectra: DataFrame, windows: DataFrame | None = None, levels: tuple[str, ...] = ("L2", "L3", "L4"), tolerance: float = 20.0, max_charge: int = 2,
    least_peaks: int = 10, reach: float = 0.5, label: dict[str, float] | None = SILAC, most: int = 20,
) -> DataFrame:
    """A row for each trap that has a spectrum and candidates: (id, run, scan, candidates, light_<count>, heavy_scan, heavy_<count>), counts as ``mirror`` gives them.

    ``classified``: (id, run, scan, rt_min, rt_start, rt_stop, precursor_mz, charge, peptide, group, level). ``matches``: the same columns for all matches;
    its targets are the candidates. Without a scan the nearest in time counts, within half the elution, or ``reach`` minutes where that isn't known.
    The heavy mirror takes the scan nearest in time whose window holds the heavy precursor, if the
    trap has labelled residues, some candidate is heavy, and the scan is another one; else its columns are null.
    """
    windows = dia_windows(spectra) if windows is None else windows
    own = ["mods"] if "mods" in classified.columns and "mods" in matches.columns else []
    named = (F.col("scan") > 0) | (F.col("rt_min").isNotNull() & F.col("precursor_mz").isNotNull())
    traps = classified.where((F.col("group") == "trap") & F.col("level").isin(*levels) & named & (F.col("run") != ""))
    half = (F.col("rt_stop") - F.col("rt_start")) / 2
    traps = materialise(traps.select("id", "run", "scan", "rt_min", "rt_start", "rt_stop", "precursor_mz", "charge", "peptide", *own, F.when(half > 0, half).otherwise(F.lit(reach)).alias("reach")))
    sides = ["id", "run", "peptide", "precursor_mz", "rt_start", "rt_stop", *own]
    found = materialise(candidates(traps.select(*sides), matches.where((F.col("group") == "target") & F.col("run").isNotNull()).select(*sides), windows, label, most))
    timed = scan_at(spectra, traps.where("coalesce(scan, 0) <= 0").select("id", "run", F.col("rt_min").alias("at"), F.col("precursor_mz").alias("mz"), "reach"))
    placed = traps.join(timed.withColumnRenamed("scan", "_s"), "id", "left").withColumn("scan", F.when(F.col("scan") > 0, F.col("scan")).otherwise(F.col("_s"))).drop("_s")
    many = found.groupBy("id").agg(F.count(F.lit(1)).alias("candidates"), F.max("heavy").alias("some_heavy"))
    peaks = by_level(spectra, 2).select("run", "scan", "mz")
    light = materialise(placed.where("scan is not null").join(many, "id").join(peaks.where(F.size("mz") >= least_peaks), ["run", "scan"]))
    trap_form = lambda rows, heavy: rows.select("id", F.lit(0).alias("candidate"), "peptide", F.lit(heavy).alias("heavy"), *own)
    forms = found.select("id", "candidate", "peptide", "heavy", *own)
    prefixed = lambda counts, side: counts.select("id", *[F.col(c).alias(f"{side}_{c}") for c in COUNTS])
    out = light.select("id", "run", "scan", "candidates").join(prefixed(mirror(light.select("id", "mz"), trap_form(light, False).unionByName(forms), tolerance, max_charge, label), "light"), "id")
    if label is None:
        return out.withColumns({"heavy_scan": F.lit(None).cast("int")} | {f"heavy_{c}": F.lit(None).cast("long") for c in COUNTS})
    shift = heavy_delta(F.col("peptide"), label)
    wanted = light.where(F.col("some_heavy") & (shift > 0) & (F.col("precursor_mz") > 0))
    heavier = F.col("precursor_mz") + shift / F.coalesce("charge", F.lit(2))
    at = scan_at(spectra, wanted.select("id", "run", F.coalesce("rt_min", F.lit(0.0)).alias("at"), heavier.alias("mz"), "reach"))
    partner = wanted.drop("mz").join(at.withColumnRenamed("scan", "heavy_scan"), "id").where("heavy_scan <> scan")
    partner = materialise(partner.join(peaks.withColumnRenamed("scan", "heavy_scan"), ["run", "heavy_scan"]))
    heavy = prefixed(mirror(partner.select("id", "mz"), trap_form(partner, True).unionByName(forms), tolerance, max_charge, label), "heavy")
    return out.join(partner.select("id", "heavy_scan"), "id", "left").join(heavy, "id", "left")


def chimeric_share(rows: DataFrame) -> DataFrame:
    """``rows`` as ``trace_multi_target`` returns them with ``shared_ratio``: peaks that trap and targets share, of all peaks, light and heavy together."""
    total = lambda names: sum((F.coalesce(f"{side}_{c}", F.lit(0)) for side in ("light", "heavy") for c in names), F.lit(0))
    return rows.withColumn("shared_ratio", F.when(total(COUNTS) > 0, total(("shared",)) / total(COUNTS)).otherwise(0.0))
