"""The index engine against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from massq.functions import chem
from massq.operators import digest, engine, fdr, search
from massq.operators.shared import materialise

STEP = chem.ISOTOPE_STEP
SPECTRA = "run string, scan int, ms_level int, rt_min double, precursors array<struct<mz:double,charge:int,intensity:double,isolation:struct<target:double,lower:double,upper:double>,source_scan:int>>, mz array<double>, intensity array<double>, representation string"


def mass(p):
    return sum(chem.RESIDUES[c] for c in p) + chem.WATER


def ions(p):
    """Neutral b and y fragments as (kind, number, mass)."""
    out, prefix = [], 0.0
    for k, c in enumerate(p[:-1], 1):
        prefix += chem.RESIDUES[c]
        out += [("b", k, prefix), ("y", len(p) - k, mass(p) - prefix)]
    return out


def spectrum(k, p, shift=0.0, noise=(), charge=2, keep=1.0, rng=None):
    peaks = [((m + chem.PROTON) * (1 + 2e-6), 10.0 + n) for _, n, m in ions(p) if rng is None or rng.random() < keep]
    peaks = sorted(peaks + [(x, 1.0) for x in noise])
    mz = (mass(p) + shift + charge * chem.PROTON) / charge
    return ("r", k, 2, k / 10, [(mz, charge, None, None, None)], [x for x, _ in peaks], [y for _, y in peaks], "centroid")


PROTEINS = [("P1", "MAGICWANDSKPEPTIDERLLNNGGFFKAAAGGGTTTLLKSAMPLERVVK"), ("P2", "GRANDPEPTIDEKWYYSTTSLLRDDEEAAGGHHKLMNPQRSSTTVVWWYYK"), ("P3", "AVLIMFWKGGPSTCYNQRDEHKRAVGSSEETTLKQQNNAAGGSSLLRFFYYWWHHK")]


@pytest.fixture(scope="module")
def proteins(spark):
    return spark.createDataFrame(PROTEINS, "accession string, sequence string")


def test_isotope_peaks_fold_into_the_lightest():
    mz = np.array([300.0, 500.0, 500.0 + STEP / 2, 500.0 + STEP, 500.0 + 3 * STEP / 2, 700.0, 700.0 + STEP])
    got = engine.folded(mz, np.array([5.0, 100, 60, 30, 10, 10, 20]), 3, 10)
    assert got[0].tolist() == [300.0, 500.0, 700.0, 700.0 + STEP] and got[1].tolist() == [5, 200, 10, 20]
    assert [x.tolist() for x in engine.folded(np.array([]), np.array([]), 3, 10)] == [[], []]


def plain_fold(mz, intensity, charges, ppm):
    total, charge, gone = list(intensity), [0] * len(mz), [False] * len(mz)
    for i in reversed(range(len(mz))):
        for z in [charge[i]] if charge[i] else range(charges, 0, -1):
            found = [(abs(mz[j] - (mz[i] - STEP / z)), j) for j in range(len(mz)) if intensity[j] > intensity[i] and abs(mz[j] - (mz[i] - STEP / z)) <= mz[i] * ppm * 1e-6]
            if found:
                j = min(found)[1]
                total[j], charge[j], gone[i] = total[j] + total[i], z, True
                break
    return [(m, t) for m, t, g in zip(mz, total, gone, strict=True) if not g]


@pytest.mark.parametrize("seed", range(5))
def test_folding_against_a_plain_version(seed):
    rng = random.Random(seed)
    mz = sorted(rng.choice([400, 500, 500.3]) + rng.randint(0, 9) * STEP / rng.choice([1, 2, 3]) + rng.uniform(-0.006, 0.006) for _ in range(60))
    intensity = [float(rng.randint(1, 50)) for _ in mz]
    got = engine.folded(np.array(mz), np.array(intensity), 3, 10)
    assert np.stack(got, axis=1).tolist() == [list(x) for x in plain_fold(mz, intensity, 3, 10)]


def test_preparing(spark):
    rows = [("r", 1, 2, 0.0, [], [3.0, 1.0, 2.0, 2.5], [1.0, 5.0, 5.0, 9.0], "centroid"), ("r", 2, 2, 0.0, [], [], [], "centroid"), ("r", 3, 1, 0.0, [], [1.0], [1.0], "centroid")]
    got = {r.scan: (r.mz, r.intensity) for r in engine.prepared(spark.createDataFrame(rows, SPECTRA), top=2).collect()}
    assert got == {1: ([1.0, 2.5], [5.0, 9.0]), 2: ([], [])}


@pytest.mark.parametrize(("tolerance", "unit"), [(10.0, "ppm"), (0.02, "Da"), (0.9, "Da"), (3.0, "Da")])
def test_isotope_join_gives_each_pair_once(spark, tolerance, unit):
    rng = random.Random(7)
    measured = [(k, 1000 + rng.choice([0, STEP, 2 * STEP, 3 * STEP, 4 * STEP, -STEP]) + rng.uniform(-0.02, 0.02)) for k in range(60)]
    peptides = [(k, 1000 + rng.uniform(-0.03, 0.03) + rng.choice([0, 0, 1.5])) for k in range(60)]
    want = []
    for i, x in measured:
        for j, m in peptides:
            off, _, k = min((abs(x - k * STEP - m), -k if x - m < 0 else k, k) for k in range(-1, 4))
            if off <= (m * tolerance * 1e-6 if unit == "ppm" else tolerance):
                want.append((i, j, k))
    got = engine.isotope_join(spark.createDataFrame(measured, "i long, neutral_mass double"), spark.createDataFrame(peptides, "j long, mass double"), tolerance, unit).select("i", "j", "isotope_error").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_index_holds_the_fragments(spark):
    fixed, variable = (chem.CARBAMIDOMETHYL, chem.Modification("TMT", 229.0, "", "peptide_nterm")), (chem.OXIDATION,)
    rows = spark.createDataFrame([(1, "PEMCK", 600.0, [(0, 2)]), (2, "GK", 200.0, []), (3, "A", 89.0, [])], "pid long, peptide string, mass double, combination array<struct<mod:int,pos:int>>")
    got = {(r.pid, r.kind, r.number): r.fragment for r in engine.fragment_index(rows, fixed, variable, 0).collect()}
    m = chem.RESIDUES
    residues = [m["P"] + 229, m["E"], m["M"] + 15.994915, m["C"] + 57.021464, m["K"]]
    want = {(1, "b", k): sum(residues[:k]) for k in range(1, 5)} | {(1, "y", k): sum(residues[5 - k :]) + chem.WATER for k in range(1, 5)} | {(2, "b", 1): m["G"] + 229, (2, "y", 1): m["K"] + chem.WATER}
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("window", "precursor_unit", "unit", "reach"), [(500.0, "Da", "ppm", 20.0), (10.0, "ppm", "ppm", 20.0), (10.0, "ppm", "Da", 0.02), (3.0, "Da", "Da", 0.5)])
def test_votes_against_all_pairs(spark, proteins, window, precursor_unit, unit, reach):
    peptides = engine._numbered(search.candidates(proteins, missed=1), "pid")
    rng = random.Random(3)
    names = sorted({r.peptide for r in peptides.collect()})
    made = [spectrum(k, p, rng.choice([0.0, STEP, 80.0]), [rng.uniform(100, 900) for _ in range(10)], rng.choice([2, 3]), 0.7, rng) for k, p in enumerate(names[:25])]
    isotopes = (-1, 3) if precursor_unit == "ppm" else (0, 0)
    queries = [(r[1], (r[4][0][0] - chem.PROTON) * r[4][0][1], r[4][0][1], r[5]) for r in made]
    frame = spark.createDataFrame(queries, "qid long, neutral_mass double, charge int, mz array<double>")
    got = {(r.qid, r.pid): r.votes for r in engine.fragment_votes(frame, engine.fragment_index(peptides), window, reach, unit, precursor_unit, isotopes).collect()}
    want: Counter = Counter()
    for q, neutral, z, mz in queries:
        for r in peptides.collect():
            off = min(abs(neutral - k * STEP - r.mass) for k in range(isotopes[0], isotopes[1] + 1))
            if off <= (r.mass * window * 1e-6 if precursor_unit == "ppm" else window):
                for _, n, m in ions(r.peptide):
                    if n > 2:
                        for f in (1, 2) if z >= 3 else (1,):
                            t = (m + f * chem.PROTON) / f
                            want[q, r.pid] += sum(abs(x - t) <= (t * reach * 1e-6 if unit == "ppm" else reach) for x in mz)
    assert got == {k: v for k, v in want.items() if v} and len(got) > 20


def test_open_search_finds_shifted_peptides(spark, proteins):
    names = sorted(r.peptide for r in digest.digest(proteins, missed=0).select("peptide").distinct().collect())
    rows = spark.createDataFrame([spectrum(k, p, 79.966 if k % 2 else 0.0) for k, p in enumerate(names)], SPECTRA)
    got = {r.scan: r for r in engine.open_search(rows, proteins, missed=0, drop_decoys=False).collect()}
    for k, p in enumerate(names):
        assert got[k].peptide == p and got[k].mass_shift == pytest.approx(79.966 if k % 2 else 0.0, abs=1e-3)
        assert got[k].longest_y == len(p) - 1 and got[k].longest_y_share == pytest.approx((len(p) - 1) / len(p))


def test_search_by_engine_and_isotope_errors(spark, proteins):
    names = sorted(r.peptide for r in digest.digest(proteins, missed=0).select("peptide").distinct().collect())
    rows = spark.createDataFrame([spectrum(k, p, STEP * (k % 4)) for k, p in enumerate(names)], SPECTRA)
    got = {r.scan: r for r in search.search(rows, proteins, missed=0, engine="hyperscore").collect()}
    assert {k: (r.peptide, r.isotope_error) for k, r in got.items()} == {k: (p, k % 4) for k, p in enumerate(names)}
    none = search.search(rows, proteins, missed=0, engine="hyperscore", decoy="none").collect()
    assert none and all(r.q_value is None and r.peptide_q is None for r in none)


def test_wide_windows_give_no_match(spark, proteins):
    r = list(spectrum(1, "PEPTIDER"))
    wide, narrow = (500.0, 12.5, 12.5), (500.0, 1.0, 1.0)
    of = lambda k, *windows: (*r[:1], k, *r[2:4], [(r[4][0][0], 2, None, w, None) for w in windows], *r[5:])
    rows = spark.createDataFrame([of(1, wide), of(2, narrow), of(3, wide, wide), of(4, None)], SPECTRA)
    assert sorted(x.scan for x in search.precursors(rows).collect()) == [2, 3, 3, 4] and search.precursors(rows, widest=None).count() == 5


def test_discriminant_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal([1, 2, 3], [1, 2, 0.5], (300, 3)), rng.normal([0, 1, 3.5], [1, 2, 0.5], (200, 3))])
    y = np.array([False] * 300 + [True] * 200)
    rows = spark.createDataFrame([(*map(float, v), bool(d)) for v, d in zip(x, y, strict=True)], "a double, b double, c double, is_decoy boolean")
    weights, offset = engine.discriminant(rows, ["a", "b", "c"])
    within = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in (x[~y], x[y])) / 498
    want = np.linalg.solve(within, x[~y].mean(0) - x[y].mean(0))
    assert weights == pytest.approx(want.tolist()) and offset == pytest.approx(-want @ (x[~y].mean(0) + x[y].mean(0)) / 2)
    scores = [r.s for r in rows.select(engine.discriminant_score(weights, offset, ["a", "b", "c"]).alias("s")).collect()]
    assert scores == pytest.approx((x @ want + offset).tolist())
    assert engine.discriminant(rows.where("not is_decoy"), ["a"]) is None and engine.discriminant(rows.withColumn("d", F.col("a") * 2), ["a", "d"]) is None


def test_fallback_where_no_discriminant_follows(spark):
    rows = spark.createDataFrame([(-2.0, 0.6, False), (5.0, 0.0, False)], "poisson double, longest_y_share double, is_decoy boolean")
    got = [r.discriminant for r in engine.rescored(rows, ("poisson",)).collect()]
    assert got == pytest.approx([math.log1p(2.0) + 0.2, math.log1p(-0.999)])


def test_picked_peptides(spark):
    rng = random.Random(5)
    peptides = ["".join(rng.choice("ACDEFGHK") for _ in range(6)) for _ in range(40)]
    turned = [p[:-1][::-1] + p[-1] for p in peptides]
    rows = [(p, float(rng.randint(0, 20)), False) for p in peptides for _ in range(2)] + [(t, float(rng.randint(0, 15)), True) for t in turned[:30]] + [("ZZDECOYK", 9.0, True)]
    best: dict = defaultdict(dict)
    for p, s, d in rows:
        base = p[:-1][::-1] + p[-1] if d else p
        best[base][d] = max(s, best[base].get(d, s))
    winners = sorted(((b[False], False, p) if False in b and b[False] >= b.get(True, -1) else (b[True], True, p) for p, b in best.items()), key=lambda w: -w[0])
    rates = {s: min(1, sum(d for t, d, _ in winners if t >= s) / max(1, sum(not d for t, d, _ in winners if t >= s))) for s, _, _ in winners}
    want = {p: (s, min(v for t, v in rates.items() if t <= s)) for s, d, p in winners if not d}
    got = {r.peptide: (r.score, r.q_value) for r in fdr.picked_peptide_q(spark.createDataFrame(rows, "peptide string, score double, is_decoy boolean")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_longest_runs():
    hit = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1, 0], bool)
    assert search.longest_runs(hit, np.array([0, 0, 0, 0, 1, 1, 1, 2, 3, 3]), 5).tolist() == [2, 2, 0, 1, 0]


def test_nothing_to_search(spark, proteins):
    assert materialise(engine.index_search(spark.createDataFrame([], SPECTRA), proteins)).count() == 0
