"""Predicates and string functions of the analysis, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from massq.functions.chem import RESIDUES, mass_map

DECOY_PREFIXES = ("REV_", "SHUF_", "DECOY_", "REVERSED_")


def within_ppm(observed: Column, theoretical: Column, ppm: float) -> Column:
    """Inclusive, relative to the theoretical value; false where that isn't positive."""
    return F.when(theoretical > 0, F.abs(observed - theoretical) / theoretical * 1e6 <= ppm).otherwise(False)


def within_da(observed: Column, theoretical: Column, da: float) -> Column:
    return F.abs(observed - theoretical) <= da


def delta_ppm(observed: Column, theoretical: Column) -> Column:
    return F.when(theoretical != 0, (observed - theoretical) / theoretical * 1e6).otherwise(0.0)


def window_contains(target: Column, lower: Column, upper: Column, mz: Column) -> Column:
    return mz.between(target - lower, target + upper)


def same_window(a_mid: Column, a_width: Column, b_mid: Column, b_width: Column) -> Column:
    """Centres under 1 apart and widths that differ by less than a fifth of the first."""
    return (F.abs(a_mid - b_mid) < 1.0) & F.when(a_width > 0, F.abs(a_width - b_width) / a_width < 0.2).otherwise(a_width == b_width)


def trim_peaks(mz: Column, intensity: Column, center: Column, window: float) -> Column:
    """Peaks (mz, intensity) within a distance of a centre."""
    return F.filter(F.arrays_zip(mz.alias("mz"), intensity.alias("intensity")), lambda p: F.abs(p["mz"] - center) <= window)


def passes_q(q: Column, threshold: float) -> Column:
    """For inference: rows without a q-value pass."""
    return q.isNull() | (q <= threshold)


def is_decoy(accession: Column) -> Column:
    return accession.rlike("^(" + "|".join(DECOY_PREFIXES) + ")")


def fold_il(sequence: Column) -> Column:
    return F.translate(sequence, "I", "L")


def family_name(accession: Column) -> Column:
    """Third pipe-separated field up to ``_``, else the first accession."""
    third = F.split_part(accession, F.lit("|"), F.lit(3))
    return F.when(third != "", F.split_part(third, F.lit("_"), F.lit(1))).otherwise(F.split_part(accession, F.lit(";"), F.lit(1)))


def uniprot_id(accession: Column) -> Column:
    """Bare id of ``sp|ID|...`` or ``tr|ID|...``, else null."""
    found = F.regexp_extract(accession, r"^(?:sp|tr)\|([^|]+)\|", 1)
    return F.when(found != "", found)


def ion_label(label: Column) -> Column:
    """``b3+1`` as (type, number, charge)."""
    part = lambda k: F.regexp_extract(label, r"^([a-z])(\d+)\+(\d+)$", k)
    return F.when(part(1) != "", F.struct(part(1).alias("type"), part(2).try_cast("int").alias("number"), part(3).try_cast("int").alias("charge")))


def sanitize_tsv(value: Column) -> Column:
    return F.translate(value, "\t\n\r;", "    ")


def escape_html(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def letters(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def differences(a: Column, b: Column) -> Column:
    """Mismatches (pos from 0, x, y) of two sequences of one length; null for other lengths."""
    pairs = F.transform(F.zip_with(letters(a), letters(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p, i: F.struct(i.alias("pos"), p["x"].alias("x"), p["y"].alias("y")))
    return F.when(F.length(a) == F.length(b), F.filter(pairs, lambda p: p["x"] != p["y"]))


def hamming(a: Column, b: Column) -> Column:
    return F.size(differences(a, b))


def substitution_mass(diffs: Column) -> Column:
    """Sum of mass changes over mismatches; unknown residues count 0."""
    mass = lambda c: F.coalesce(F.try_element_at(mass_map(RESIDUES), c), F.lit(0.0))
    return F.aggregate(diffs, F.lit(0.0), lambda t, d: t + mass(d["y"]) - mass(d["x"]))


def mod_mass_at(mods: Column, diffs: Column) -> Column:
    """Mass of modifications (pos, mass) that sit where two sequences differ: what a mass change doesn't count."""
    return F.aggregate(F.filter(mods, lambda m: F.exists(diffs, lambda d: d["pos"] == m["pos"])), F.lit(0.0), lambda t, m: t + m["mass"])


def difference_text(diffs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(diffs, lambda d: F.concat(d["pos"].cast("string"), F.lit(":"), d["x"], F.lit("->"), d["y"])), ","), F.lit("]"))


def only_il(a: Column, b: Column) -> Column:
    return (a != b) & (fold_il(a) == fold_il(b))


def single_qk(diffs: Column) -> Column:
    pair = lambda d: F.concat(d["x"], d["y"]).isin("QK", "KQ")
    return (F.size(diffs) == 1) & F.exists(diffs, pair)


def isobaric_dipeptide(shorter: Column, longer: Column) -> Column:
    """N against GG, or Q against AG or GA, with everything else equal: the residue, else null."""
    n = F.length(shorter)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        one, two = F.substring(shorter, i, F.lit(1)), F.substring(longer, i, F.lit(2))
        rest = (F.substring(shorter, F.lit(1), i - 1) == F.substring(longer, F.lit(1), i - 1)) & (F.substring(shorter, i + 1, n) == F.substring(longer, i + 2, n + 1))
        kind = ((one == "N") & (two == "GG")) | ((one == "Q") & two.isin("AG", "GA"))
        return F.when(rest & kind, one)

    found = F.array_compact(F.transform(places, at))
    return F.when(F.length(longer) == n + 1, F.try_element_at(found, F.lit(1)))


def substitution_category(diffs: Column, dipeptide: Column, delta_mass: Column, threshold: float = 1.0) -> Column:
    return F.when(F.coalesce(single_qk(diffs), F.lit(False)), "qk").when(dipeptide.isNotNull(), "isobaric_dipeptide").when(F.abs(delta_mass) < threshold, "near_isobaric").otherwise("distinguishable")


def alignment_positions(detail: Column) -> Column:
    """Positions of substitutions in a text like ``N3→D,ins:G@5``."""
    return F.transform(F.regexp_extract_all(detail, F.lit(r"[A-Z](\d+)→"), 1), lambda x: x.cast("int"))


def lower_median(values: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {values})")


def upper_median(values: str) -> Column:
    """Element n/2 of the sorted values."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))
