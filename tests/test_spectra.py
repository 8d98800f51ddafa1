"""Isotope patterns and annotation against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from massq.functions import chem
from massq.operators import spectra as S
from massq.sources import spectra as files

STEP = chem.ISOTOPE_STEP


def plain_patterns(mz, intensity, low, high, tol, least, ratio, rise):
    """Word by word: the closest peak or none, no peak twice, from the most intense seed down."""
    peaks = sorted((k for k in range(len(mz)) if low <= mz[k] <= high), key=lambda k: -intensity[k])
    used, found = set(), []
    for seed in peaks:
        if seed in used:
            continue
        best = None
        for z in (2, 3, 4, 5):
            cluster = [seed]

            def closest(place):
                near = [(abs(mz[k] - place), n, k) for n, k in enumerate(peaks) if k not in used and k not in cluster and abs(mz[k] - place) <= tol]
                return min(near)[2] if near else None

            k = closest(mz[seed] - STEP / z)
            if k is not None and intensity[k] >= ratio * intensity[seed]:
                cluster.append(k)
            at = seed
            while True:
                k = closest(mz[at] + STEP / z)
                if k is None or intensity[k] > rise * intensity[at] or intensity[k] < ratio * intensity[seed]:
                    break
                cluster.append(k)
                at = k
            if len(cluster) >= least and (best is None or len(cluster) > len(best[1])):
                best = (z, cluster)
        if best:
            used |= set(best[1])
            found.append((best[0], min(mz[k] for k in best[1]), intensity[seed]))
    kept = []
    for z, m, i in sorted(found, key=lambda x: x[:2]):
        close = [x for x in kept if x[0] == z and abs(x[1] - m) < 0.01]
        if not any(x[2] >= i for x in close):
            kept = [x for x in kept if x not in close] + [(z, m, i)]
    return sorted(kept, key=lambda x: -x[2])


@pytest.mark.parametrize("tol", [0.01, 0.5])
def test_isotope_patterns_against_a_plain_version(tol):
    rng = random.Random(tol)
    for _ in range(60):
        mz = sorted(rng.choice([400, 400.4, 403]) + rng.randint(0, 6) * STEP / rng.choice([1, 2, 3, 4]) + rng.uniform(-0.012, 0.012) for _ in range(rng.randint(0, 40)))
        intensity = [float(rng.randint(1, 12)) for _ in mz]
        got = S._patterns(np.array(mz), np.array(intensity), 400.0, 404.0, tol, 2, 0.1, 1.5)
        assert [(x["charge"], x["mz"], x["intensity"]) for x in got] == plain_patterns(mz, intensity, 400.0, 404.0, tol, 2, 0.1, 1.5)


def test_a_tolerance_beyond_the_step_ends():
    assert S._patterns(np.array([100.0, 100.3, 250.0]), np.array([5.0, 4.0, 3.0]), 0, 300, 0.5, 2, 0.1, 1.5) == [{"mz": 100.0, "charge": 2, "intensity": 5.0}]


@pytest.fixture(scope="module")
def annotated(spark):
    peaks = [98.06, 129.1, 129.105, 227.1, 324.155, 375.17, 472.2, 500.0, 703.31]
    rows = spark.createDataFrame([("r", 1, peaks, [float(k + 1) for k in range(9)])], "run string, scan int, mz array<double>, intensity array<double>")
    wanted = spark.createDataFrame([("r", 1, "a", "PEPTIDE", [], 2), ("r", 1, "b", "PEPTIDE", [(1, 80.0)], 3), ("r", 1, "c", "K", [], 2)], "run string, scan int, k string, peptide string, mods array<struct<pos:int,delta:double>>, charge int")
    return rows, wanted, peaks


def plain_ions(peptide, mods, charge):
    m = [chem.RESIDUES[c] + sum(d for p, d in mods if p == k) for k, c in enumerate(peptide)]
    for z in (1, 2) if charge >= 3 else (1,):
        for k in range(1, len(m)):
            yield f"b{k}+{z}", (sum(m[:k]) + z * chem.PROTON) / z
            yield f"y{k}+{z}", (sum(m[-k:]) + chem.WATER + z * chem.PROTON) / z


def test_annotations_of_one_spectrum_are_kept_apart(spark, annotated):
    rows, wanted, peaks = annotated
    got = S.annotate(rows, wanted, 3000.0, losses=False, keys=("k",))
    for k, peptide, mods, charge in (("a", "PEPTIDE", [], 2), ("b", "PEPTIDE", [(1, 80.0)], 3)):
        want = {}
        for label, mz in plain_ions(peptide, mods, charge):
            near = min((abs(p - mz), p) for p in peaks)
            want[label] = near[1] if near[0] <= mz * 3e-3 else None
        mine = {r.label: r.observed_mz for r in got.where(F.col("k") == k).collect()}
        assert mine == want
    scores = {r.k: (r.matched, r.total) for r in S.annotation_scores(got, rows, ("k",)).collect()}
    assert scores.keys() == {"a", "b"} and scores["a"][1] == 12 and scores["b"][1] == 24


def test_each_peak_takes_its_nearest_ion(annotated):
    rows, wanted, _ = annotated
    table = S.annotate(rows, wanted, 20_000.0, keys=("k",))
    got = S.assigned_peaks(table, ("k",)).collect()
    hits = [r for r in table.collect() if r.matched]
    for r in got:
        mine = [h for h in hits if h.k == r.k and h.observed_mz == r.observed_mz]
        best = min(mine, key=lambda h: (round(abs(h.observed_mz - h.mz), 9), len(h.type) > 1, h.type, h.number, h.charge))
        assert (r.label, r.mz, r.observed_intensity) == (best.label, best.mz, best.observed_intensity)
    assert len(got) == len({(h.k, h.observed_mz) for h in hits})


def test_no_peaks(spark):
    rows = spark.createDataFrame([("r", 1, [], [])], "run string, scan int, mz array<double>, intensity array<double>")
    table = S.annotate(rows, spark.createDataFrame([("r", 1, "PEK")], "run string, scan int, peptide string"))
    assert table.count() == 24 and table.where("matched").count() == 0 and S.assigned_peaks(table).count() == 0


def test_a_look_up_parses_its_own_scan(spark, tmp_path):
    one = lambda index, name: f'<spectrum index="{index}" id="{name}"><cvParam accession="MS:1000511" value="2"/></spectrum>'
    (tmp_path / "a.mzML").write_text("<mzML>" + "".join(one(k, f"controller=1 scan={n}") for k, n in enumerate(("1", "2", "12", "21", "02"))) + one(1, "x") + one(6, "y"))
    path = f"file://{tmp_path}/a.mzML"
    assert sorted(r.scan for r in files.read_scan(spark, path, 2).collect()) == [2, 2, 2, 7]  # spectra without a number of their own are parsed too
    assert S.spectrum(files.read_scan(spark, path, 2), 2).count() == S.spectrum(files.read(spark, path), 2).count() == 3
