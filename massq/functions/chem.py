"""Peptide chemistry as column expressions: masses, m/z, fragment ions, labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic residue masses in Da.
RESIDUES = {
    "G": 57.021464, "A": 71.037114, "V": 99.068414, "L": 113.084064, "I": 113.084064, "P": 97.052764, "F": 147.068414,
    "W": 186.079313, "M": 131.040485, "S": 87.032028, "T": 101.047679, "C": 103.009185, "Y": 163.063329, "H": 137.058912,
    "D": 115.026943, "E": 129.042593, "N": 114.042927, "Q": 128.058578, "K": 128.094963, "R": 156.101111,
}
WATER, PROTON, AMMONIA, ISOTOPE_STEP = 18.010565, 1.007276, 17.026549, 1.003355
SILAC = {"K": 8.014199, "R": 10.008269}
STANDARD = "".join(RESIDUES)


@dataclass(frozen=True)
class Modification:
    """``position``: anywhere, peptide_nterm, peptide_cterm, protein_nterm or protein_cterm. No residues: any."""

    name: str
    delta: float
    residues: str = ""
    position: str = "anywhere"


CARBAMIDOMETHYL = Modification("Carbamidomethyl", 57.021464, "C")
OXIDATION = Modification("Oxidation", 15.994915, "M")


def mass_map(masses: dict[str, float] = RESIDUES) -> Column:
    return F.create_map(*[F.lit(x) for pair in masses.items() for x in pair])


def _count(sequence: Column, residues: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, residues, ""))


def residue_mass(residue: Column, rounded: bool = False) -> Column:
    """Null for what isn't a residue; the rounded table (five digits) gives 0 there instead."""
    if rounded:
        return F.coalesce(F.try_element_at(mass_map({k: round(v, 5) for k, v in RESIDUES.items()}), residue), F.lit(0.0))
    return F.try_element_at(mass_map(), residue)


def is_standard(sequence: Column) -> Column:
    return sequence.rlike(f"^[{STANDARD}]*$")


def residue_sum(sequence: Column, masses: dict[str, float] = RESIDUES) -> Column:
    """Sum over residues by counting each kind: 20 linear passes in generated code, no array."""
    total = F.lit(0.0)
    for residue, mass in masses.items():
        total = total + _count(sequence, residue) * F.lit(mass)
    return total


def peptide_mass(sequence: Column) -> Column:
    return F.when(is_standard(sequence), residue_sum(sequence) + F.lit(WATER))


def _laid(sequences: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all sequences, one after the other, and how long each is; null counts as empty."""
    texts = sequences.to_pylist()
    return np.frombuffer("".join(filter(None, texts)).encode("utf-32-le"), "<u4"), np.array([len(t or "") for t in texts], np.int64)


def peptide_masses(sequence: Column) -> Column:
    """``peptide_mass`` to the last bit, for tables of many: batches in Arrow, where each kind of residue is counted in one pass over all letters.

    Called nondeterministic, so that conditions on a mass stay above the aggregate that tells peptides apart, and don't weigh each occurrence.
    """

    def masses(sequences: pa.Array) -> pa.Array:
        letters, size = _laid(sequences)
        of, total, known = np.repeat(np.arange(len(size)), size), np.zeros(len(size)), np.zeros(len(size), np.int64)
        for residue, mass in RESIDUES.items():
            n = np.bincount(of[letters == ord(residue)], minlength=len(size))
            total, known = total + n * mass, known + n
        return pa.array(total + WATER, mask=(known != size) | np.asarray(sequences.is_null().cast(pa.int8())).astype(bool))

    def plain(sequences: pa.Array) -> pa.Array:
        return masses(sequences)

    return F.arrow_udf(plain, "double").asNondeterministic()(sequence)


def residue_prefixes(sequence: Column, combination: Column, masses: dict[str, float], first: float, last: float, deltas: tuple[float, ...]) -> Column:
    """Running sums of residues from the first on as an array; ``combination``: array of (mod, pos), ``deltas`` by mod.

    A batch lies in a table of a row each, summed along it, so sums are those of adding residue after residue.
    """
    table = np.full(256, np.nan)
    for residue, mass in masses.items():
        table[ord(residue)] = mass

    def sums(sequences: pa.Array, placed: pa.Array) -> pa.Array:
        letters, size = _laid(sequences)
        ends = np.cumsum(size)
        value, some = table[letters], size > 0
        value[(ends - size)[some]] += first
        value[ends[some] - 1] += last
        if deltas:
            site, sites = placed.flatten(), np.asarray(placed.value_lengths().fill_null(0))
            of = np.repeat(np.arange(len(size)), sites)
            mod, pos = (np.asarray(site.field(c)) for c in ("mod", "pos"))
            more = np.zeros(len(value))
            np.add.at(more, (ends - size)[of] + np.clip(pos, 0, size[of] - 1), np.array(deltas)[mod])
            value = value + more
        inside = np.arange(size.max(initial=0)) < size[:, None]
        laid = np.zeros(inside.shape)
        laid[inside] = value
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.cumsum(laid, axis=1)[inside]))

    def plain(sequences: pa.Array, placed: pa.Array) -> pa.Array:
        return sums(sequences, placed)

    return F.arrow_udf(plain, "array<double>").asNondeterministic()(sequence, combination)  # else a condition that Spark infers has it run twice


def mz(mass: Column, charge: Column) -> Column:
    """m/z of a neutral mass; a charge under 1 is an error."""
    return F.when(charge >= 1, (mass + charge * F.lit(PROTON)) / charge).otherwise(F.raise_error(F.lit("charge must be positive")).cast("double"))


def mh_to_mz(mh: Column, charge: Column) -> Column:
    return F.when(charge >= 1, (mh + (charge - 1) * F.lit(PROTON)) / charge)


def fixed_mod_mass(sequence: Column, mods: tuple[Modification, ...], protein_nterm: Column | None = None, protein_cterm: Column | None = None) -> Column:
    """What fixed modifications add to a whole peptide."""
    no = F.lit(False)
    first, last = F.substring(sequence, 1, 1), F.substring(sequence, -1, 1)
    total = F.lit(0.0)
    for m in mods:
        fits = lambda c, m=m: F.lit(True) if not m.residues else c.isin(*m.residues)
        if m.position == "anywhere":
            n = _count(sequence, m.residues) if m.residues else F.lit(1)
            total = total + n * F.lit(m.delta)
        else:
            end = first if m.position.endswith("nterm") else last
            flag = {"protein_nterm": protein_nterm, "protein_cterm": protein_cterm}.get(m.position, F.lit(True))
            total = total + F.when(fits(end) & (no if flag is None else flag), F.lit(m.delta)).otherwise(0.0)
    return total


def prefix_masses(sequence: Column, deltas: dict[str, float] | None = None, mods: Column | None = None) -> Column:
    """Masses of the prefixes of 1 to n - 1 residues, with what ``deltas`` adds to residues and ``mods`` (pos from 0, delta) to places."""
    masses = {k: v + (deltas or {}).get(k, 0.0) for k, v in RESIDUES.items()}
    n = F.length(sequence)
    ends = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    residue = lambda i: F.coalesce(F.try_element_at(mass_map(masses), F.substring(sequence, i, F.lit(1))), F.lit(0.0))
    added = lambda i: F.lit(0.0) if mods is None else F.aggregate(F.filter(mods, lambda m: m["pos"] == i - 1), F.lit(0.0), lambda t, m: t + m["delta"])
    letters = F.transform(ends, lambda i: residue(i) + added(i))
    sums = F.aggregate(letters, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    return sums


def b_ions(sequence: Column, deltas: dict[str, float] | None = None, max_charge: int = 1) -> Column:
    """n - 1 ions, all charges of one before the next."""
    return F.flatten(F.transform(prefix_masses(sequence, deltas), lambda m: F.array(*[(m + z * PROTON) / z for z in range(1, max_charge + 1)])))


def y_ions(sequence: Column, deltas: dict[str, float] | None = None, max_charge: int = 1) -> Column:
    suffix = prefix_masses(F.reverse(sequence), deltas)
    return F.flatten(F.transform(suffix, lambda m: F.array(*[(m + F.lit(WATER) + z * PROTON) / z for z in range(1, max_charge + 1)])))


ION = "struct<label:string,type:string,number:int,charge:int,mz:double>"


def _fragment_masses(letters: np.ndarray, first: np.ndarray, size: np.ndarray, masses: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Masses of all prefixes and suffixes of 1 to n - 1 letters, sequence by sequence, from how often each residue occurs.

    ``letters``: code points of all sequences, ``first`` and ``size`` where each begins and how long it is. Equal compositions have equal masses to the last bit.
    """
    inner = np.maximum(size - 1, 0)
    number = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    begin, end = np.repeat(first, inner), np.repeat(first + size, inner)
    prefixes, suffixes = np.zeros(len(number)), np.zeros(len(number))
    for residue, mass in masses.items():
        so_far = np.concatenate([[0], np.cumsum(letters == ord(residue))])
        prefixes += (so_far[begin + number] - so_far[begin]) * mass
        suffixes += (so_far[end] - so_far[end - number]) * mass
    return prefixes, suffixes


def _placed(mods: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What modifications (pos from 0, delta) add to the prefixes and suffixes of ``_fragment_masses``."""
    inner = np.maximum(size - 1, 0)
    at = np.cumsum(inner) - inner
    prefixes, suffixes = np.zeros(inner.sum()), np.zeros(inner.sum())
    for k, found in enumerate(mods.to_pylist()):
        for m in found or ():
            if 0 <= m["pos"] < size[k]:
                prefixes[at[k] + m["pos"] : at[k] + inner[k]] += m["delta"]
                suffixes[at[k] + size[k] - 1 - m["pos"] : at[k] + inner[k]] += m["delta"]
    return prefixes, suffixes


def theoretical_ions(sequence: Column, deltas: dict[str, float] | None = None, max_charge: int = 2, losses: bool = False, mods: Column | None = None) -> Column:
    """Array of (label, type, number, charge, mz): all b, then all y by charge; labels like ``b3+1``. ``mods``: array of (pos from 0, delta).

    A batch of sequences is worked on as a whole; each row's ions come from its own sequence.
    """
    masses = {k: v + (deltas or {}).get(k, 0.0) for k, v in RESIDUES.items()}
    series = [(kind, loss, shift, z) for kind in "by" for loss, shift in [("", 0.0)] + [("-H2O", WATER), ("-NH3", AMMONIA)] * losses for z in range(1, max_charge + 1)]

    def ions(sequences, placed=None):
        texts = sequences.to_pylist()
        letters = np.frombuffer("".join(filter(None, texts)).encode("utf-32-le"), "<u4")
        size = np.array([len(t or "") for t in texts], np.int64)
        inner = np.maximum(size - 1, 0)
        b, y = _fragment_masses(letters, np.cumsum(size) - size, size, masses)
        if placed is not None:
            more_b, more_y = _placed(placed, size)
            b, y = b + more_b, y + more_y
        y = y + WATER
        ends = np.concatenate([[0], np.cumsum(inner * len(series))])
        number = np.arange(len(b)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        base, step, most = np.repeat(ends[:-1], inner) + number - 1, np.repeat(inner, inner), int(inner.max(initial=0))
        at, numbers, mz = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.int32), np.empty(ends[-1])
        for k, (kind, _, shift, z) in enumerate(series):
            place = base + k * step
            at[place], numbers[place], mz[place] = k, number, ((b if kind == "b" else y) - shift + z * PROTON) / z
        labels = pa.array([f"{kind}{n}{loss}+{z}" for kind, loss, _, z in series for n in range(1, most + 1)], pa.string())
        types, charges = pa.array([kind + loss for kind, loss, _, _ in series], pa.string()), pa.array([z for *_, z in series], pa.int32())
        columns = [labels.take(pa.array(at * most + numbers - 1)), types.take(pa.array(at)), pa.array(numbers), charges.take(pa.array(at)), pa.array(mz)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["label", "type", "number", "charge", "mz"]), mask=pa.array([t is None for t in texts]))

    def plain(sequences: pa.Array) -> pa.Array:
        return ions(sequences)

    def modified(sequences: pa.Array, placed: pa.Array) -> pa.Array:
        return ions(sequences, placed)

    return F.arrow_udf(plain, f"array<{ION}>")(sequence) if mods is None else F.arrow_udf(modified, f"array<{ION}>")(sequence, mods)


def heavy_delta(fragment: Column, label: dict[str, float] = SILAC) -> Column:
    """Mass that labelled residues add, in upper or lower case."""
    total = F.lit(0.0)
    for residue, delta in label.items():
        total = total + _count(fragment, residue + residue.lower()) * F.lit(delta)
    return total


def heavy_mz(light_mz: Column, sequence: Column, charge: Column, label: dict[str, float] = SILAC) -> Column:
    return F.when(charge >= 1, light_mz + heavy_delta(sequence, label) / charge)
