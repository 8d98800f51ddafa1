"""The index engine: prepared spectra, candidates by shared fragments, isotope errors, discriminant scores.

A precursor band lets nearly every peptide through once it is hundreds of Da wide. Here candidates
come from an inverted index: a peptide's fragments stand in bins of mass, a spectrum's peaks
look their own bins up, and what a pair of spectrum and peptide shares is counted as votes, which Spark sums
up before it shuffles them. Peaks meet peptides only where the precursor window lets them, as the
window's mass is part of the join's key. Only pairs with enough votes are scored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massq.functions.chem import ISOTOPE_STEP, PROTON, RESIDUES, WATER, Modification, residue_prefixes
from massq.operators.fdr import FdrError, picked_peptide_q, picked_q, with_q
from massq.operators.joins import band_join, ppm_join
from massq.operators.search import best_matches, candidates, precursors, scored_pairs
from massq.operators.shared import materialise

#: Charges tried where a spectrum names none; isotope errors; masses of peptides (Da); peaks that a spectrum keeps and a match needs.
CHARGES, ISOTOPES, MASSES, TOP, LEAST = (2, 3, 4), (-1, 3), (500.0, 5000.0), 150, 4
#: Fragments up to this number are left out of the index: b1, b2, y1 and y2 are shared by too many peptides to tell them apart.
SHORT = 2
#: What the discriminant is made of.
FEATURES = ("score", "matched", "longest_y", "longest_y_share", "error", "isotope_error", "length", "charge", "poisson")


def folded(mz: np.ndarray, intensity: np.ndarray, charges: int, ppm: float) -> tuple[np.ndarray, np.ndarray]:
    """A spectrum without isotope peaks: each is added to the lighter, more intense peak one isotope step below it.

    From the heaviest peak down; the highest charge whose step fits counts, since a wider step would skip peaks between, and the charge that a peak
    got from a heavier one is the only one tried for it, so a pattern ends in its lightest peak. ``mz`` rises.
    """
    total, charge, gone, tolerance = intensity.astype(float), np.zeros(len(mz), int), np.zeros(len(mz), bool), mz * ppm * 1e-6
    at = [mz - ISOTOPE_STEP / z for z in range(1, charges + 1)]
    lo = [np.searchsorted(mz, a - tolerance, "left") for a in at]
    hi = [np.searchsorted(mz, a + tolerance, "right") for a in at]
    some = np.flatnonzero(np.any([h > l for l, h in zip(lo, hi, strict=True)], axis=0))
    for i in some[::-1].tolist():
        for z in [charge[i]] if charge[i] else range(charges, 0, -1):
            lighter = np.arange(lo[z - 1][i], hi[z - 1][i])
            lighter = lighter[intensity[lighter] > intensity[i]]
            if len(lighter):
                j = lighter[np.abs(mz[lighter] - at[z - 1][i]).argmin()]
                total[j] += total[i]
                charge[j], gone[i] = z, True
                break
    return mz[~gone], total[~gone]


def strongest(peaks: Column, n: int) -> Column:
    """The ``n`` most intense of (mz, intensity) peaks, by m/z; of equal ones the lighter."""
    ranked = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["intensity"]).alias("s"), p["mz"].alias("mz"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda p: F.struct(p["mz"].alias("mz"), (-p["s"]).alias("intensity"))))


def prepared(spectra: DataFrame, top: int = TOP, fold: bool = True, charges: int = 3, ppm: float = 10.0) -> DataFrame:
    """MS2 spectra without isotope peaks and with their ``top`` most intense peaks only, by m/z; other columns as they are."""

    @F.pandas_udf("array<struct<mz:double,intensity:double>>")
    def without_isotopes(mz: pd.Series, intensity: pd.Series) -> pd.Series:
        out = []
        for m, i in zip(mz, intensity, strict=True):
            m, i = np.asarray(m, float), np.asarray(i, float)
            order = np.lexsort((i, m))
            out.append([{"mz": a, "intensity": b} for a, b in zip(*(x.tolist() for x in folded(m[order], i[order], charges, ppm)), strict=True)])
        return pd.Series(out)

    peaks = without_isotopes("mz", "intensity") if fold else F.arrays_zip("mz", "intensity")
    rows = spectra.where("ms_level = 2").withColumn("_p", peaks).withColumn("_p", strongest(F.col("_p"), top))
    return rows.withColumns({"mz": F.col("_p.mz"), "intensity": F.col("_p.intensity")}).drop("_p")


def isotope_error(neutral: Column, mass: Column, isotopes: tuple[int, int] = ISOTOPES) -> Column:
    """How many isotope steps, of those allowed, bring a measured mass nearest to a peptide's."""
    return F.greatest(F.lit(isotopes[0]), F.least(F.lit(isotopes[1]), F.round((neutral - mass) / ISOTOPE_STEP).cast("int")))


def _within(neutral: Column, mass: Column, tolerance: float, unit: str, isotopes: tuple[int, int]) -> Column:
    off = F.abs(neutral - isotope_error(neutral, mass, isotopes) * ISOTOPE_STEP - mass)
    return off <= (mass * tolerance * 1e-6 if unit == "ppm" else F.lit(tolerance))


def isotope_join(measured: DataFrame, peptides: DataFrame, tolerance: float, unit: str = "ppm", isotopes: tuple[int, int] = ISOTOPES) -> DataFrame:
    """Pairs of ``measured`` (neutral_mass, ...) and ``peptides`` (mass, ...) within tolerance after the best isotope error.

    One band join: the measured side is repeated for each error, and a pair is kept
    where the error is its best one, so it comes out once however wide the tolerance is. Adds ``isotope_error``.
    """
    shifted = measured.withColumn("isotope_error", F.explode(F.sequence(F.lit(isotopes[0]), F.lit(isotopes[1])))).withColumn("_m", F.col("neutral_mass") - F.col("isotope_error") * ISOTOPE_STEP)
    if unit == "ppm":
        pairs = ppm_join(shifted, peptides, "_m", "mass", tolerance * 1.001)
    else:
        bands = shifted.withColumns({"_lo": F.col("_m") - tolerance, "_hi": F.col("_m") + tolerance})
        pairs = band_join(peptides, bands, "mass", "_lo", "_hi", 2 * tolerance).drop("_lo", "_hi")
    best = isotope_error(F.col("neutral_mass"), F.col("mass"), isotopes)
    return pairs.where((F.col("isotope_error") == best) & _within(F.col("neutral_mass"), F.col("mass"), tolerance, unit, isotopes)).drop("_m")


def fragment_index(peptides: DataFrame, fixed: tuple[Modification, ...] = (), variable: tuple[Modification, ...] = (), short: int = SHORT) -> DataFrame:
    """(pid, mass, kind, number, fragment): neutral masses of b and y fragments of over ``short`` residues, with their peptide's mass.

    ``peptides``: (pid, peptide, combination, mass) as ``candidates`` returns them, numbered.
    """
    residues = {k: v + sum(m.delta for m in fixed if m.position == "anywhere" and (not m.residues or k in m.residues)) for k, v in RESIDUES.items()}
    ends = {side: sum(m.delta for m in fixed if m.position == f"peptide_{side}") for side in ("nterm", "cterm")}
    n = F.length("peptide")
    sums = residue_prefixes(F.col("peptide"), F.col("combination"), residues, ends["nterm"], ends["cterm"], tuple(m.delta for m in variable))
    rows = peptides.where(n > 0).select("pid", "mass", "peptide", sums.alias("sums"))
    rows = rows.select("pid", "mass", F.element_at("sums", -1).alias("whole"), F.posexplode("sums").alias("k", "prefix"), n.alias("n"))
    ions = F.array(F.struct(F.lit("b").alias("kind"), (F.col("k") + 1).alias("number"), F.col("prefix").alias("fragment")), F.struct(F.lit("y").alias("kind"), (n_left := F.col("n") - F.col("k") - 1).alias("number"), (F.col("whole") - F.col("prefix") + WATER).alias("fragment")))
    return rows.where(n_left > 0).select("pid", "mass", F.inline(ions)).where(F.col("number") > short)


def fragment_votes(queries: DataFrame, index: DataFrame, tolerance: float, fragment_tolerance: float, unit: str = "ppm", precursor_unit: str = "ppm", isotopes: tuple[int, int] = ISOTOPES) -> DataFrame:
    """(qid, pid, votes): how many of a query's peaks a peptide in its precursor window explains.

    ``queries``: (qid, neutral_mass, charge, mz, intensity). A peak may have charge 1, or 2 where the precursor has 3 or more.
    """
    reach = F.col("neutral_mass") * (tolerance * 1.01e-6) if precursor_unit == "ppm" else F.lit(float(tolerance))
    lo, hi = F.col("neutral_mass") - isotopes[1] * ISOTOPE_STEP - reach, F.col("neutral_mass") - isotopes[0] * ISOTOPE_STEP + reach
    span = (isotopes[1] - isotopes[0]) * ISOTOPE_STEP + 2 * (MASSES[1] * tolerance * 1.01e-6 if precursor_unit == "ppm" else tolerance)
    width = max(span, 10.0)
    charges = F.when(F.col("charge") >= 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    peaks = queries.select("qid", "neutral_mass", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))).alias("_m"), charges.alias("_z"), "mz")
    peaks = peaks.select("qid", "neutral_mass", "_m", F.explode("mz").alias("mz"), "_z").select("qid", "neutral_mass", "_m", "mz", F.explode("_z").alias("z"))
    peaks = peaks.withColumn("_f", (F.col("mz") - PROTON) * F.col("z")).where("_f > 0")
    # A tolerance on m/z is a little more on the neutral mass: by the protons' share, under a tenth from 57 Da on.
    part = fragment_tolerance * 1.1e-6
    if unit == "ppm":
        place, spread = lambda c: F.floor(F.ln(c) / (4 * part)), (F.col("_f") * (1 - part), F.col("_f") * (1 + part))
    else:
        place, spread = lambda c: F.floor(c / (8 * fragment_tolerance)), (F.col("_f") - 2.01 * fragment_tolerance, F.col("_f") + 2.01 * fragment_tolerance)
    peaks = peaks.withColumn("_b", F.explode(F.sequence(place(F.greatest(spread[0], F.lit(1e-3))), place(spread[1]))))
    entries = index.select("pid", "mass", "fragment", F.floor(F.col("mass") / width).alias("_m"), place(F.col("fragment")).alias("_b"))
    theory = (F.col("fragment") + F.col("z") * PROTON) / F.col("z")
    close = F.abs(F.col("mz") - theory) <= (theory * fragment_tolerance * 1e-6 if unit == "ppm" else F.lit(fragment_tolerance))
    met = peaks.join(entries, ["_m", "_b"]).where(close & _within(F.col("neutral_mass"), F.col("mass"), tolerance, precursor_unit, isotopes))
    return met.groupBy("qid", "pid").agg(F.count(F.lit(1)).alias("votes"))


def discriminant(rows: DataFrame, features: Sequence[str], decoy: str = "is_decoy") -> tuple[list[float], float] | None:
    """Weights and offset of the linear discriminant that tells targets (above 0) from decoys, or None where none follows.

    One aggregate sums values and products by class, so what reaches the driver is a few numbers whatever the table's size. None: a class
    has under two rows, or the features don't vary independently.
    """
    d = len(features)
    values = [F.col(f).cast("double") for f in features]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    by = {r["c"]: r for r in rows.groupBy(F.col(decoy).alias("c")).agg(F.count(F.lit(1)).alias("n"), *sums).where("c is not null").collect()}  # two rows
    if len(by) < 2 or min(r["n"] for r in by.values()) < 2:
        return None
    means = {c: np.array([r[f"s{i}"] for i in range(d)], float) / r["n"] for c, r in by.items()}
    scatter = np.zeros((d, d))
    for c, r in by.items():
        second = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
        scatter += second - r["n"] * np.outer(means[c], means[c])
    within = scatter / (sum(r["n"] for r in by.values()) - 2)
    if not np.isfinite(within).all() or np.linalg.matrix_rank(within) < d:
        return None
    weights = np.linalg.solve(within, means[False] - means[True])
    return weights.tolist(), float(-weights @ (means[False] + means[True]) / 2)


def discriminant_score(weights: Sequence[float], offset: float, features: Sequence[str]) -> Column:
    return sum((F.col(f).cast("double") * float(w) for f, w in zip(features, weights, strict=True)), F.lit(float(offset)))


def fallback_score(poisson: str = "poisson", longest_y_share: str = "longest_y_share") -> Column:
    """What stands for the discriminant where there is none: the surprise of so many matches, and the run of y ions."""
    return F.log1p(F.greatest(-F.col(poisson), F.lit(-0.999))) + F.col(longest_y_share) / 3.0


def rescored(matches: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``matches`` with ``discriminant``: by those of ``features`` that vary, else by the fallback formula."""
    spread = matches.agg(*[F.coalesce(F.stddev(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in features]).first()
    used = [f for f in features if spread[f] > 0]
    found = discriminant(matches, used) if used else None
    return matches.withColumn("discriminant", fallback_score() if found is None else discriminant_score(*found, used))


def _log_factorial(k: Column) -> Column:
    """Of a whole number from 0, by a sum: counts of ions are small."""
    return F.aggregate(F.when(k > 1, F.sequence(F.lit(2), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda t, x: t + F.ln(x))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number each, written, so that every later read has the same."""
    return materialise(rows.withColumn(name, F.monotonically_increasing_id()))


def index_search(
    spectra: DataFrame, proteins: DataFrame, tolerance: float = 10.0, fragment_tolerance: float = 20.0, unit: str = "ppm", fixed: tuple[Modification, ...] = (), variable: tuple[Modification, ...] = (), max_mods: int = 2,
    decoy: str = "reverse", drop_decoys: bool = True, precursor_unit: str = "ppm", isotopes: tuple[int, int] = ISOTOPES, least: int = LEAST, top: int = TOP, fold: bool = True, **digestion,
) -> DataFrame:
    """Best match of each precursor, by hyperscore, with discriminant score and q-values of matches, peptides and proteins.

    A Da tolerance is one of mass. Rows as ``search`` returns them, and votes, isotope_error, longest_y, longest_y_share, poisson, discriminant,
    peptide_q and protein_q; q-values are null where none follows (no decoys).
    """
    peptides = _numbered(candidates(proteins, fixed, variable, max_mods, decoy=decoy, **digestion), "pid").where(F.col("mass").between(*MASSES))  # a mass is computed once, of distinct peptides
    rows = prepared(spectra, top, fold)
    queries = _numbered(precursors(rows, CHARGES, None).join(rows.select("run", "scan", "mz", "intensity"), ["run", "scan"]), "qid")
    votes = materialise(fragment_votes(queries, fragment_index(peptides, fixed, variable), tolerance, fragment_tolerance, unit, precursor_unit, isotopes))
    pairs = votes.where(F.col("votes") >= least).join(queries.drop("mz", "intensity"), "qid").join(peptides, "pid")
    pairs = pairs.withColumn("isotope_error", isotope_error(F.col("neutral_mass"), F.col("mass"), isotopes))
    scored = scored_pairs(pairs, queries, ("qid",), fixed, variable, fragment_tolerance, unit, True, True).where(F.col("matched") >= least)
    best = best_matches(scored)
    chance = votes.groupBy("qid").agg((F.sum("votes") / F.count(F.lit(1))).alias("expected"))
    k, mean = F.col("votes"), F.col("expected")
    shifted = F.col("neutral_mass") - F.col("isotope_error") * ISOTOPE_STEP
    best = best.join(chance, "qid").withColumns({
        "poisson": F.greatest((k * F.ln(mean) - mean - _log_factorial(k)) / F.ln(F.lit(10.0)), F.lit(-325.0)),
        "longest_y_share": F.col("longest_y") / F.length("peptide"), "length": F.length("peptide"), "error": F.abs(shifted - F.col("mass")) / F.col("mass") * 1e6,
        "calculated_mz": (F.col("mass") + F.col("charge") * PROTON) / F.col("charge"), "delta_ppm": (shifted - F.col("mass")) / F.col("mass") * 1e6,
    })
    return with_levels(rescored(materialise(best.drop("expected", "qid", "pid"))), drop_decoys)


def with_levels(matches: DataFrame, drop_decoys: bool = True) -> DataFrame:
    """``matches`` with q-values by ``discriminant``: of spectra, of peptides picked against their reverse, of proteins picked against theirs."""
    rows = materialise(matches)
    try:
        out = with_q(rows, "discriminant")
        peptides = picked_peptide_q(rows, score="discriminant").select("peptide", F.col("q_value").alias("peptide_q"))
        proteins = picked_q(rows.groupBy(F.col("accession").alias("leader")).agg(F.max("discriminant").alias("score"))).select(F.col("leader").alias("accession"), F.col("q_value").alias("protein_q"))
        out = out.join(peptides, "peptide", "left").join(proteins, "accession", "left")
    except FdrError:
        out = rows.withColumns({c: F.lit(None).cast("double") for c in ("q_value", "peptide_q", "protein_q")})
    return out.where("not is_decoy") if drop_decoys else out


def open_search(spectra: DataFrame, proteins: DataFrame, window: float = 500.0, **settings) -> DataFrame:
    """``index_search`` in a precursor window of ``window`` Da, without isotope errors; adds ``mass_shift``, what the peptide's mass leaves over."""
    found = index_search(spectra, proteins, tolerance=window, precursor_unit="Da", isotopes=(0, 0), **settings)
    return found.withColumn("mass_shift", F.col("neutral_mass") - F.col("mass"))


__all__ = ["discriminant", "fragment_index", "fragment_votes", "index_search", "isotope_join", "open_search", "prepared", "rescored"]
