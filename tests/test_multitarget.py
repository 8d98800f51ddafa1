"""Multi-target provenance against a plain version."""

import random

import pytest

from massq.functions import chem
from massq.operators import multitarget as M
from massq.sources import sinks

SPECTRA = "run string, scan int, ms_level int, rt_min double, precursors array<struct<mz:double,charge:int,intensity:double,isolation:struct<target:double,lower:double,upper:double>,source_scan:int>>, mz array<double>, intensity array<double>, representation string"
MATCH = "id long, run string, scan int, rt_min double, rt_start double, rt_stop double, precursor_mz double, charge int, peptide string, group string, level string, mods array<struct<pos:int,delta:double>>"


def ions(peptide, mods, heavy, max_charge=2):
    m = [chem.RESIDUES[c] + (chem.SILAC.get(c, 0) if heavy else 0) + sum(d for p, d in mods if p == k) for k, c in enumerate(peptide)]
    return [(x + z * chem.PROTON) / z for k in range(1, len(m)) for x in (sum(m[:k]), sum(m[-k:]) + chem.WATER) for z in range(1, max_charge + 1)]


def shift(p):
    return sum(chem.SILAC.get(c, 0) for c in p)


def plain_mirror(mz, trap, forms, tolerance):
    near = lambda x, lines: any(abs(x - t) / t * 1e6 <= tolerance for t in lines)
    counts = {"trap_only": 0, "target_only": 0, "shared": 0, "unassigned": 0}
    for x in mz:
        t, o = near(x, trap), any(near(x, f) for f in forms)
        counts["shared" if t and o else "trap_only" if t else "target_only" if o else "unassigned"] += 1
    return tuple(counts[c] for c in M.COUNTS)


def plain_scan(spectra, run, at, mz, reach):
    near = [(abs(s[3] - at), s[3], s[1]) for s in spectra if s[0] == run and s[2] == 2 and abs(s[3] - at) <= reach and s[4][0][3][0] - s[4][0][3][1] <= mz <= s[4][0][3][0] + s[4][0][3][2]]
    return min(near)[2] if near else None


def plain_trace(matches, spectra, windows, tolerance, least, most, label=True):
    peaks = {(s[0], s[1]): s[5] for s in spectra if s[2] == 2}
    out = {}
    window = lambda run, mz: next((t for r, t, lo, hi in windows if r == run and t - lo <= mz <= t + hi), None)
    for id_, run, scan, rt, start, stop, mz, z, peptide, group, level, mods in matches:
        if group != "trap" or level not in ("L2", "L3", "L4"):
            continue
        reach = (stop - start) / 2 if start is not None and stop is not None and stop > start else 0.5
        scan = scan if scan and scan > 0 else plain_scan(spectra, run, rt, mz, reach)
        if (run, scan) not in peaks or len(peaks[run, scan]) < least:
            continue
        forms = []
        for o in sorted((o for o in matches if o[9] == "target" and o[1] == run and o[8] != peptide and start <= o[5] and o[4] <= stop and window(run, o[6]) is not None and window(run, o[6]) == window(run, mz)), key=lambda o: (o[4], o[0])):
            forms += [(o[8], o[11], False)] + ([(o[8], o[11], True)] if label and shift(o[8]) else [])
        forms = forms[:most]
        if not forms:
            continue
        lines = [ions(*f) for f in forms]
        heavy_scan, heavy = None, None
        if label and shift(peptide) > 0 and any(f[2] for f in forms):
            heavy_scan = plain_scan(spectra, run, rt, mz + shift(peptide) / (z or 2), reach)
            if heavy_scan == scan or (run, heavy_scan) not in peaks:
                heavy_scan = None
            else:
                heavy = plain_mirror(peaks[run, heavy_scan], ions(peptide, mods, True), lines, tolerance)
        out[id_] = (run, scan, len(forms), plain_mirror(peaks[run, scan], ions(peptide, mods, False), lines, tolerance), heavy_scan, heavy)
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    words = ["".join(rng.choice("ADEGKLNRSTV") for _ in range(rng.randint(5, 9))) for _ in range(110)]
    windows = [(run, t, 60.0, 60.0) for run in ("a", "b") for t in (300.0, 400.0, 500.0)]
    matches, spectra = [], []
    for k, p in enumerate(words):
        mods = [(1, 15.99)] if k % 7 == 0 else []
        mz = (sum(chem.RESIDUES[c] for c in p) + chem.WATER + sum(d for _, d in mods) + 2 * chem.PROTON) / 2
        rt = rng.randint(0, 40) / 10
        run = "ab"[k % 2]
        wide = rng.choice([0.2, 0.5])
        matches.append((k, run, [None, k, 999][k % 3], rt, rt - wide, rt + wide, mz, rng.choice([2, None]), p, "trap" if k % 3 < 2 else "target", rng.choice(["L2", "L3", "L1"]), mods))
        held = min((w for w in windows), key=lambda w: abs(w[1] - mz))
        light = ions(p, mods, False)
        spectra.append((run, k, 2, rt, [(mz, 2, None, (held[1], 60.0, 60.0), None)], sorted(x * (1 + rng.uniform(-25e-6, 25e-6)) for x in light + ions(rng.choice(words), [], rng.random() < 0.5)), [], "centroid"))
        spectra.append((run, 1000 + k, 2, rt + 0.01, [(mz, 2, None, (held[1] + 20.0, 60.0, 60.0), None)], sorted(ions(p, mods, True))[: rng.choice([4, 40])], [], "centroid"))
    return matches, spectra, windows


@pytest.mark.parametrize(("most", "label"), [(20, True), (3, True), (20, False)])
def test_against_a_plain_version(spark, data, most, label):
    matches, spectra, windows = data
    frame = spark.createDataFrame(matches, MATCH)
    w = spark.createDataFrame(windows, "run string, target double, lower double, upper double")
    found = M.trace_multi_target(frame, frame, spark.createDataFrame(spectra, SPECTRA), w, label=chem.SILAC if label else None, most=most, least_peaks=6).collect()
    got = {r.id: (r.run, r.scan, r.candidates, tuple(r[f"light_{c}"] for c in M.COUNTS), r.heavy_scan, None if r.heavy_shared is None else tuple(r[f"heavy_{c}"] for c in M.COUNTS)) for r in found}
    want = plain_trace(matches, spectra, windows, 20.0, 6, most, label)
    assert got == want and len(want) > 8 and (not label or any(v[5] for v in want.values()))


def test_chimeric_rule_counts_both_mirrors(spark):
    rows = spark.createDataFrame([(1, 5, 0, 4, 1, None, None, None, None), (2, 1, 0, 0, 9, 0, 0, 9, 1), (3, 0, 0, 3, 7, 0, 0, 3, 7), (4, 0, 0, 0, 0, None, None, None, None)], "id int, " + ", ".join(f"{s}_{c} long" for s in ("light", "heavy") for c in M.COUNTS))
    got = {r.id: (round(r.shared_ratio, 6), r.is_chimeric) for r in sinks.chimeric(rows).collect()}
    assert got == {1: (0.4, True), 2: (0.45, True), 3: (0.3, False), 4: (0.0, False)}
    assert "0.45" in sinks.multi_target_page("t", rows)


def test_heavy_partners(spark):
    """A wide window takes the nearest scan that holds the heavy precursor; a narrow one also looks at its precursor."""
    from massq.operators.multitarget import heavy_partners

    mz = (sum(chem.RESIDUES[c] for c in "PEPTIDEK") + chem.WATER + 2 * chem.PROTON) / 2
    heavy = mz + chem.SILAC["K"] / 2
    scan = lambda n, rt, p, half: ("r", n, 2, rt, [(p, 2, None, (p, half, half), None)], [], [], "centroid")
    rows = spark.createDataFrame([scan(1, 1.0, mz, 0.5), scan(2, 1.2, heavy * (1 + 30e-6), 0.5), scan(3, 1.3, heavy, 0.5), scan(4, 5.0, mz, 0.5), scan(5, 5.1, heavy * (1 + 5e-6), 0.5), scan(6, 9.0, mz, 2.0), scan(7, 9.3, heavy + 1, 2.0), scan(8, 9.6, heavy, 2.0)], SPECTRA)
    wanted = spark.createDataFrame([(1, "r", 1, "PEPTIDEK", 2), (4, "r", 4, "PEPTIDEK", 2), (6, "r", 6, "PEPTIDEK", 2), (9, "r", 6, "PEPTIDE", 2)], "id int, run string, scan int, peptide string, charge int")
    got = {r.id: (r.scan, r.heavy_mz) for r in heavy_partners(rows, wanted).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 4: 5, 6: 7} and got[1][1] == pytest.approx(heavy)
