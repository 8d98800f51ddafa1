"""Precursors as MS1 scans show them, against a plain version."""

import random

import pytest

from massq.functions import chem
from massq.operators import spectra as S
from massq.operators.search import scored_pairs

SCHEMA = "run string, scan int, ms_level int, rt_min double, precursors array<struct<mz:double,charge:int,intensity:double,isolation:struct<target:double,lower:double,upper:double>,source_scan:int>>, mz array<double>, intensity array<double>"


def theory(p, z, mods, heavy=False):
    m = sum(chem.RESIDUES[c] + (chem.SILAC.get(c, 0) if heavy else 0) for c in p) + chem.WATER + sum(d for _, d in mods or [])
    return (m + z * chem.PROTON) / z


def plain(spectra, run, scan, p, z, mods):
    own = next(s for s in spectra if s[:2] == (run, scan) and s[2] == 2)
    ms1 = sorted((abs(s[3] - own[3]), s[3], s[1], s) for s in spectra if s[0] == run and s[2] == 1)

    def shown(t):
        near = [(-i, m) for m, i in zip(ms1[0][3][5], ms1[0][3][6], strict=True) if abs(m - t) <= t * 20e-6 and i > 0] if ms1 else []
        return min(near)[1] if near else None

    light, heavy = theory(p, z, mods), theory(p, z, mods, True)
    seen, other = shown(light), shown(heavy) if heavy > light else None
    observed = seen if seen is not None else own[4][0][0]
    return light, observed, seen is not None, (observed - light) / light * 1e6, heavy if heavy > light else None, None if other is None else (other - heavy) / heavy * 1e6


def test_observed_precursors(spark):
    rng = random.Random(5)
    peptides = ["SAMPLEAGK", "GRANDR", "PEPTIDE", "VVLLK", "MAGICWANDSK"]
    spectra, wanted = [], []
    for run in ("a", "b", "none"):
        for scan in range(1, 60):
            rt = scan // 2 * 0.5  # scans share times
            if rng.random() < 0.3 and run != "none":
                peaks = sorted((theory(p, z, [], h) * (1 + rng.uniform(-30, 30) * 1e-6), rng.choice([0.0, 1.0, 5.0])) for p in peptides for z in (1, 2) for h in (False, True) if rng.random() < 0.7)
                spectra.append((run, scan, 1, rt + 0.1 + scan / 1000, [], [m for m, _ in peaks], [i for _, i in peaks]))
            else:
                p, z, mods = rng.choice(peptides), rng.choice([1, 2]), rng.choice([None, [], [(0, 1e-3)]])
                spectra.append((run, scan, 2, rt, [(theory(p, z, []) + 0.01, z, None, None, None)], [], []))
                wanted.append((len(wanted), run, scan, p, z, mods))
                if rng.random() < 0.3:
                    wanted.append((len(wanted), run, scan, rng.choice(peptides), 2, None))
    rows = spark.createDataFrame(spectra, SCHEMA)
    got = {r.id: r for r in S.observed_precursors(rows, spark.createDataFrame(wanted, "id int, run string, scan int, peptide string, charge int, mods array<struct<pos:int,delta:double>>")).collect()}
    assert len(got) == len(wanted)
    for id_, *w in wanted:
        r = got[id_]
        want = plain(spectra, *w)
        assert (r.in_ms1, r.heavy_mz is None, r.heavy_delta_ppm is None) == (want[2], want[4] is None, want[5] is None)
        assert [r.theoretical_mz, r.observed_mz, r.delta_ppm] == pytest.approx([want[0], want[1], want[3]], abs=1e-6)
        assert r.heavy_delta_ppm is None or r.heavy_delta_ppm == pytest.approx(want[5], abs=1e-6)
    assert {r.in_ms1 for r in got.values()} == {True, False} and any(r.heavy_delta_ppm is not None for r in got.values())


def test_observed_precursors_edges(spark):
    rows = spark.createDataFrame([("r", 1, 2, 1.0, [], None, None), ("r", 2, 1, 1.1, None, None, None)], SCHEMA)
    odd = spark.createDataFrame([(1, "r", 1, "AXB", 2), (2, "r", 1, "SAMPLEK", 0), (3, "r", 1, None, 2), (4, "r", 9, "SAMPLEK", 2), (5, "r", 1, "SAMPLEK", 2)], "id int, run string, scan int, peptide string, charge int")
    got = {r.id: r for r in S.observed_precursors(rows, odd).collect()}
    assert set(got) == {1, 2, 3, 5} and all(r.observed_mz is None and not r.in_ms1 for r in got.values())
    assert [got[k].theoretical_mz is None for k in (1, 2, 3, 5)] == [True, True, True, False]


def test_candidates_of_a_spectrum_over_many_batches(spark):
    """A spectrum is met by all its candidates wherever Arrow batches end, and one without peaks by none of another's."""
    peptides = ["SAMPLEAGK", "GRANDR", "PEPTIDEK", "VVLLK"]
    ions = lambda p: sorted(x + chem.PROTON for k in range(1, len(p)) for x in (sum(chem.RESIDUES[c] for c in p[:k]), sum(chem.RESIDUES[c] for c in p[k:]) + chem.WATER))
    peaks = [(k, list(reversed(ions(p))), [1.0] * (2 * len(p) - 2)) for k, p in enumerate(peptides)] + [(9, None, None)]
    pairs = [(k, 2**62 + n, p, 2, []) for k, *_ in peaks for n in range(7) for p in peptides]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = scored_pairs(spark.createDataFrame(pairs, "key int, big long, peptide string, charge int, combination array<struct<mod:int,pos:int>>"), spark.createDataFrame(peaks, "key int, mz array<double>, intensity array<double>"), ("key",), (), (), 20.0, "ppm", True)
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(pairs) and {r.big for r in got} == {2**62 + n for n in range(7)}
    for r in got:
        heard = [] if r.key == 9 else ions(peptides[r.key])
        assert r.total == 2 * len(r.peptide) - 2 and r.matched == sum(any(abs(m - x) <= x * 20e-6 for m in heard) for x in ions(r.peptide))
