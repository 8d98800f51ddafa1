"""Peptide-spectrum matching: candidates, fragment scores, best matches, roll-ups, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massq.functions.chem import PROTON, RESIDUES, WATER, Modification, fixed_mod_mass, peptide_masses
from massq.operators.digest import digest, site_combinations, sites, with_decoys
from massq.operators.fdr import FdrError, with_q
from massq.operators.joins import band_join, ppm_join
from massq.operators.shared import materialise, median

#: Charges tried, in this order, where a spectrum names none.
CHARGES = (2, 3, 1, 4)
#: Windows (Da) beyond which a precursor says little about the peptides inside.
WIDEST = 5.0


def candidates(proteins: DataFrame, fixed: tuple[Modification, ...] = (), variable: tuple[Modification, ...] = (), max_mods: int = 2, enzyme: str = "trypsin", missed: int = 2, decoy: str = "reverse", shortest: int = 7, longest: int = 50) -> DataFrame:
    """One row per distinct (peptide, modification set): mass, combination, first accession in order, is_decoy.

    The masses are computed once here and joined, not once a spectrum. Of the proteins that
    share a peptide the first in (targets before decoys, accession, digest order) stands for it.
    """
    rows = digest(with_decoys(proteins, decoy), enzyme, missed, shortest, longest, keep=("accession", "is_decoy"))
    first = rows.groupBy("peptide").agg(F.min(F.struct("is_decoy", "accession", "ord", "is_protein_nterm", "is_protein_cterm")).alias("m"))
    found = first.select("peptide", "m.is_decoy", "m.accession", "m.ord", F.col("m.is_protein_nterm").alias("nterm"), F.col("m.is_protein_cterm").alias("cterm"))
    s = F.col("peptide")
    mass = peptide_masses(s) + fixed_mod_mass(s, fixed, F.col("nterm"), F.col("cterm"))
    if not variable:
        none = F.array().cast("array<struct<mod:int,pos:int>>")
        return found.withColumns({"combination": none, "combo_ord": F.lit(0), "mass": mass}).drop("nterm", "cterm")
    rows = found.withColumn("_sites", sites(s, variable)).select("*", F.posexplode(site_combinations(F.col("_sites"), max_mods)).alias("combo_ord", "combination"))
    delta = F.create_map(*[x for k, m in enumerate(variable) for x in (F.lit(k), F.lit(m.delta))])
    return rows.withColumn("mass", mass + F.aggregate("combination", F.lit(0.0), lambda t, x: t + F.element_at(delta, x["mod"]))).drop("_sites", "nterm", "cterm")


def precursors(spectra: DataFrame, charges: tuple[int, ...] = CHARGES, widest: float | None = WIDEST) -> DataFrame:
    """One row per MS2 precursor and charge tried: (run, scan, precursor, charge, charge_ord, neutral_mass, precursor_mz).

    A spectrum of one precursor in a window of over ``widest`` Da has none: such precursors
    have to be extracted first. Several precursors are extracted ones and all stay.
    """
    rows = spectra.where("ms_level = 2")
    if widest is not None:
        iso = F.try_element_at("precursors", F.lit(1))["isolation"]
        rows = rows.where((F.size("precursors") > 1) | ~F.coalesce(iso["lower"] + iso["upper"] > widest, F.lit(False)))
    rows = rows.select("run", "scan", F.posexplode("precursors").alias("precursor", "p"))
    tried = F.when(F.col("p.charge") > 0, F.array("p.charge")).otherwise(F.array(*map(F.lit, charges)))
    rows = rows.select("run", "scan", "precursor", F.col("p.mz").alias("precursor_mz"), F.posexplode(tried).alias("charge_ord", "charge"))
    return rows.withColumn("neutral_mass", (F.col("precursor_mz") - PROTON) * F.col("charge"))


def matches_within(spectra: DataFrame, peptides: DataFrame, tolerance: float, unit: str = "ppm") -> DataFrame:
    """Precursors joined with candidates whose m/z at the charge tried lies within ppm or Da.

    The join is on mass, made a little wide, and then exact: ppm of m/z is taken of the
    theoretical m/z, and a Da of m/z is as many Da of mass as there are charges.
    """
    if unit == "ppm":
        pairs = ppm_join(precursors(spectra), peptides, "neutral_mass", "mass", (tolerance * 1.05 + 0.01) * 1.5)
    else:
        reach = F.col("charge") * (tolerance * 1.001 + 1e-6)
        bands = precursors(spectra).withColumns({"_lo": F.col("neutral_mass") - reach, "_hi": F.col("neutral_mass") + reach})
        pairs = band_join(peptides, bands, "mass", "_lo", "_hi", 4 * tolerance).drop("_lo", "_hi")
    pairs = pairs.withColumn("calculated_mz", (F.col("mass") + F.col("charge") * PROTON) / F.col("charge"))
    pairs = pairs.withColumn("delta_ppm", (F.col("precursor_mz") - F.col("calculated_mz")) / F.col("calculated_mz") * 1e6)
    return pairs.where(F.abs("delta_ppm") <= tolerance if unit == "ppm" else F.abs(F.col("precursor_mz") - F.col("calculated_mz")) <= tolerance)


def _laid(lists: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of an Arrow column of lists, one after the other, and the number of the row in ``of`` that each belongs to."""
    return np.asarray(lists.flatten().cast(pa.float64())), np.repeat(of, np.asarray(lists.value_lengths().fill_null(0)))


def longest_runs(hit: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Of each row the longest run of neighbours that are hit; a row's places stand together."""
    run = np.cumsum(~hit | np.append(True, of[1:] != of[:-1])[: len(hit)])
    longest = np.zeros(rows, np.int64)
    if hit.any():
        kinds, where, sizes = np.unique(run[hit], return_index=True, return_counts=True)
        np.maximum.at(longest, of[hit][where], sizes)
    return longest


def fragment_scores(fixed: tuple[Modification, ...], variable: tuple[Modification, ...], tolerance: float, unit: str, hyperscore: bool, runs: bool = False):
    """A mapInArrow function over spectra (mz, intensity; ``_pair`` false), each with its candidates (peptide, charge, combination) after it.

    Returns the candidates with matched, total, score; with ``runs`` also longest_y, the longest run of matched y ions.
    An ion counts if any peak lies within tolerance. A batch's ions and peaks are laid end to
    end, each spectrum's in a range of its own, so one binary search serves them all. A spectrum whose candidates go on in the next
    batch is kept till then. The hyperscore is the logarithm of the factorials of matched b and y ions and of their summed intensities.
    """
    from math import lgamma

    table = np.full(256, np.nan)
    for c, m in RESIDUES.items():
        table[ord(c)] = m
    added = np.zeros(256)
    for m in fixed:
        if m.position == "anywhere":
            for c in m.residues or RESIDUES:
                added[ord(c)] += m.delta
    first, last = (sum(m.delta for m in fixed if m.position == f"peptide_{side}") for side in ("nterm", "cterm"))
    deltas = np.array([m.delta for m in variable] or [0.0])
    log_factorial = np.vectorize(lambda k: lgamma(k + 1), otypes=[float])
    apart = 1e6  # more than any m/z

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty(0), np.empty(0)
        for batch in batches:
            is_pair = np.asarray(batch.column("_pair").cast(pa.int8())) == 1
            heard_at, rows = batch.filter(pa.array(~is_pair)), batch.filter(pa.array(is_pair))
            spectrum_of = np.cumsum(~is_pair)[is_pair]  # 0: the one kept
            numbers = np.arange(1, heard_at.num_rows + 1)
            (mz, of_mz), (intensity, _) = _laid(heard_at.column("mz"), numbers), _laid(heard_at.column("intensity"), numbers)
            mz, intensity = np.concatenate([kept[0], mz]), np.concatenate([kept[1], intensity])
            peak_of = np.concatenate([np.zeros(len(kept[0]), np.int64), of_mz])
            if len(numbers):
                kept = mz[peak_of == numbers[-1]], intensity[peak_of == numbers[-1]]
            if not rows.num_rows:
                continue
            order = np.lexsort((mz, peak_of))
            mz, intensity, peak_of = mz[order], intensity[order], peak_of[order]
            n, peptides = rows.num_rows, rows.column("peptide").to_pylist()
            sizes = np.fromiter(map(len, peptides), np.int64, n)
            letters = np.frombuffer("".join(peptides).encode("ascii"), np.uint8)
            masses, starts = table[letters] + added[letters], np.cumsum(sizes) - sizes
            masses[starts] += first
            masses[starts + sizes - 1] += last
            combination = rows.column("combination")
            site, site_of = combination.flatten(), np.repeat(np.arange(n), np.asarray(combination.value_lengths().fill_null(0)))
            mod, pos = (np.asarray(pc.struct_field(site, c)) for c in ("mod", "pos"))
            np.add.at(masses, starts[site_of] + np.clip(pos, 0, sizes[site_of] - 1), deltas[mod])
            of = np.repeat(np.arange(n), sizes)
            sums = np.cumsum(masses)
            prefix = sums - (sums[starts] - masses[starts])[of]
            inner = np.ones(len(of), bool)
            inner[starts + sizes - 1] = False
            whole = prefix[starts + sizes - 1]
            b, y, of = prefix[inner], (whole[of] - prefix + WATER)[inner], of[inner]
            twice = (np.asarray(rows.column("charge")) >= 3)[of]
            ion = np.concatenate([b + PROTON, ((b + 2 * PROTON) / 2)[twice], y + PROTON, ((y + 2 * PROTON) / 2)[twice]])
            of = np.concatenate([of, of[twice]] * 2)
            is_b = np.arange(len(ion)) < len(ion) // 2
            at = np.searchsorted(peak_of * apart + mz, spectrum_of[of] * apart + ion)
            best, heard = np.full(len(ion), np.inf), np.zeros(len(ion))
            for k in (at - 1, at):
                ok = (k >= 0) & (k < len(mz))
                k = np.clip(k, 0, max(0, len(mz) - 1))
                if len(mz):
                    gap = np.where(ok & (peak_of[k] == spectrum_of[of]), np.abs(mz[k] - ion) / (ion * 1e-6 if unit == "ppm" else 1), np.inf)
                    heard = np.where(gap < best, intensity[k], heard)
                    best = np.minimum(best, gap)
            good = best <= tolerance
            count = lambda mask, w=None: np.bincount(of[mask], None if w is None else w[mask], n)  # noqa: B023, E731
            nb, ny, total = count(good & is_b), count(good & ~is_b), count(np.ones(len(of), bool))
            if hyperscore:
                value = log_factorial(nb) + log_factorial(ny) + np.log(np.maximum(count(good & is_b, heard) * count(good & ~is_b, heard), 1.0))
            else:
                value = (nb + ny) / np.maximum(1, total)
            out = {c: rows.column(c) for c in rows.schema.names if c not in ("_pair", "mz", "intensity")}
            out |= {"matched": pa.array(nb + ny, pa.int32()), "total": pa.array(total, pa.int32()), "score": pa.array(value, pa.float64())}
            if runs:
                hit, at_y = good[~is_b][: len(y)].copy(), of[~is_b][: len(y)]
                hit[np.flatnonzero(twice)[good[~is_b][len(y) :]]] = True
                out["longest_y"] = pa.array(longest_runs(hit, at_y, n), pa.int32())
            yield pa.RecordBatch.from_pydict(out)

    return score


def scored_pairs(pairs: DataFrame, peaks: DataFrame, keys: tuple[str, ...], fixed: tuple[Modification, ...], variable: tuple[Modification, ...], tolerance: float, unit: str, hyperscore: bool, runs: bool = False) -> DataFrame:
    """``pairs`` (keys, peptide, charge, combination, ...) with ``fragment_scores`` against ``peaks`` (keys, mz, intensity), a row for each key.

    A spectrum isn't joined with its candidates, which would copy its peaks to each of them: it stands before
    them in one sorted partition, which is read as a stream, so peaks are shuffled once and a spectrum of many candidates takes no memory.
    """
    none = F.array().cast("array<double>")
    own = peaks.select(*keys, F.lit(False).alias("_pair"), F.coalesce("mz", none).alias("mz"), F.coalesce("intensity", none).alias("intensity"))
    both = pairs.withColumn("_pair", F.lit(True)).unionByName(own, allowMissingColumns=True)
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", matched int, total int, score double" + (", longest_y int" if runs else "")
    return both.repartition(*keys).sortWithinPartitions(*keys, "_pair").mapInArrow(fragment_scores(fixed, variable, tolerance, unit, hyperscore, runs), schema)


def best_matches(scored: DataFrame, keys: tuple[str, ...] = ("run", "scan", "precursor"), order: tuple[str, ...] = ("is_decoy", "accession", "ord", "combo_ord", "charge_ord")) -> DataFrame:
    """The highest score of each key, ties in candidate order: an aggregate, not a sort."""
    rest = [c for c in scored.columns if c not in keys and c not in order]
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("_s"), *order, *rest)).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)])


def search(spectra: DataFrame, proteins: DataFrame, tolerance: float = 10.0, fragment_tolerance: float = 20.0, unit: str = "ppm", fixed: tuple[Modification, ...] = (), variable: tuple[Modification, ...] = (), max_mods: int = 2, decoy: str = "reverse", hyperscore: bool = False, drop_decoys: bool = True, precursor_unit: str = "ppm", engine: str = "simple", **digestion) -> DataFrame:
    """Matches with q-values. Where no q-value follows (no decoys) it is null; decoys leave last.

    ``engine``: simple takes candidates from the precursor band; hyperscore from a fragment index (``engine.index_search``).
    """
    if engine == "hyperscore":
        from massq.operators.engine import index_search

        return index_search(spectra, proteins, tolerance, fragment_tolerance, unit, fixed, variable, max_mods, decoy, drop_decoys, precursor_unit, **digestion)
    found = matches_within(spectra, materialise(candidates(proteins, fixed, variable, max_mods, decoy=decoy, **digestion)), tolerance, precursor_unit)
    scored = scored_pairs(found, spectra.where("ms_level = 2"), ("run", "scan"), fixed, variable, fragment_tolerance, unit, hyperscore).where("score > 0")
    best = materialise(best_matches(scored))
    try:
        out = with_q(best)
    except FdrError:
        out = best.withColumn("q_value", F.lit(None).cast("double"))
    return out.where("not is_decoy") if drop_decoys else out


def capped(rows: DataFrame, keys: tuple[str, ...], most: int, order: tuple[str | Column, ...], rank: str = "rank") -> DataFrame:
    """At most ``most`` candidates of each key in an order, numbered from 1; Spark drops the rest before the shuffle too."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most)


def histogram(rows: DataFrame, value: Column, width: float, start: float = 0.0) -> DataFrame:
    """(bin, n): how many values lie in each bin of a width, counted from ``start``; nulls in none."""
    return rows.groupBy(F.floor((value - start) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin is not null")


def rescored_rollup(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peptides and proteins of an engine's rescored matches (peptide, accessions, score, q_value, is_decoy): targets only.

    A peptide's q-value is that of its best score; a protein's unique peptides map to it alone.
    """
    targets = features.where("not is_decoy")
    best = F.max(F.struct(F.col("score"), (-F.col("q_value")).alias("q")))
    peptides = targets.groupBy("peptide").agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("accessions")))).alias("accessions"), F.count(F.lit(1)).alias("psm_count"))
    peptides = peptides.select("peptide", F.col("b.score").alias("best_score"), (-F.col("b.q")).alias("q_value"), "accessions", "psm_count")
    each = peptides.select(F.explode("accessions").alias("accession"), (F.size("accessions") == 1).alias("alone"))
    return peptides, each.groupBy("accession").agg(F.count(F.lit(1)).alias("peptide_count"), F.count_if("alone").alias("unique_peptide_count"))


def features_to_matches(features: DataFrame, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Matches of an engine's features (spec_id, peptide, accessions, charge, expmass, calcmass, hyperscore, spectrum_q, label).

    m/z is rebuilt from masses; rows without a charge go; a spectrum id that is no number is scan 1;
    label -1 is a decoy; ``metrics`` are kept in a map.
    """
    mz = lambda c: (F.col(c) + F.col("charge") * PROTON) / F.col("charge")
    rows = features.where("charge <> 0").withColumns({"precursor_mz": mz("expmass"), "calculated_mz": mz("calcmass")})
    extra = F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics])) if metrics else F.create_map().cast("map<string,double>")
    error = F.when(F.col("calculated_mz") > 0, (F.col("precursor_mz") - F.col("calculated_mz")) / F.col("calculated_mz") * 1e6).otherwise(0.0)
    return rows.select(F.coalesce(F.col("spec_id").try_cast("int"), F.lit(1)).alias("scan"), "peptide", "accessions", "charge", "precursor_mz", "calculated_mz", error.alias("delta_ppm"), F.col("hyperscore").alias("score"), F.col("spectrum_q").alias("q_value"), (F.col("label") == -1).alias("is_decoy"), extra.alias("extra"))


def import_summary(matches: DataFrame, total: int | None = None, q: float = 0.01, by: tuple[str, ...] = ()) -> DataFrame:
    """One row about imported matches, or about those of each of ``by``: how many there are and have a scan, the runs, what passes the q-value, and the share of spectra identified.

    Only rows with a scan count from ``matched`` on. Without a number of spectra their number stands for it.
    """
    has, good = F.col("scan").isNotNull(), F.col("scan").isNotNull() & (F.col("q_value") <= q)
    rows = matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("imported"), F.count_if(has).alias("matched"), F.countDistinct("run").alias("runs"), F.count_if(good).alias("psms_at_q"),
        F.countDistinct(F.when(good, F.col("peptide"))).alias("peptides_at_q"), F.countDistinct(F.when(has, F.struct("run", "scan"))).alias("scans"),
    )
    of = F.col("matched") if total is None else F.lit(total)
    return rows.withColumn("identification_rate", F.when(of > 0, F.col("psms_at_q") / of).otherwise(0.0))


def peptide_rollup(psms: DataFrame, peptide: str = "peptide", accession: str = "accession") -> DataFrame:
    """Best score, smallest q, distinct accessions and count of each peptide."""
    return psms.groupBy(peptide).agg(F.max("score").alias("best_score"), F.min("q_value").alias("q_value"), F.sort_array(F.collect_set(accession)).alias("accessions"), F.count(F.lit(1)).alias("psm_count"))


def protein_rollup(psms: DataFrame, peptide: str = "peptide", accession: str = "accession") -> DataFrame:
    """Distinct and unique peptides of each protein. A peptide is unique if it maps to one protein only."""
    pairs = psms.select(accession, peptide).distinct()
    owners = pairs.groupBy(peptide).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(owners, peptide).groupBy(accession).agg(F.count(F.lit(1)).alias("peptide_count"), F.count_if(F.col("n") == 1).alias("unique_peptide_count"))


def summary(psms: DataFrame, q: float = 0.01, filtered: bool = True) -> DataFrame:
    """One row: counts at a q-value, where rows without one fail unless none has any; medians over filtered or all rows."""
    flagged = psms.crossJoin(psms.agg(F.coalesce(F.max(F.col("q_value").isNotNull()), F.lit(False)).alias("_any")))  # one row
    good: Column = ~F.col("_any") | F.coalesce(F.col("q_value") <= q, F.lit(False))
    over = F.when(good, F.col("score")) if filtered else F.col("score")
    error = F.when(good, F.col("delta_ppm")) if filtered else F.col("delta_ppm")
    counts = flagged.agg(
        F.count(F.lit(1)).alias("psms"), F.count_if(good).alias("psms_at_q"), F.countDistinct(F.when(good, F.col("peptide"))).alias("peptides_at_q"),
        F.countDistinct(F.when(good, F.col("accession"))).alias("proteins_at_q"),
    )
    middle = lambda c, out: median(flagged.select(c.alias("_v")), "_v", out).select(F.coalesce(out, F.lit(0.0)).alias(out))
    return counts.crossJoin(middle(over, "median_score")).crossJoin(middle(error, "median_delta_ppm"))  # one row each

