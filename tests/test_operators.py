import random
from itertools import combinations

import numpy as np
import pytest
import theory
from pyspark.sql import functions as F

from massq.functions import chem
from massq.functions import exprs as X
from massq.operators import advice, digest, entrapment, fdr, inference, joins, search, shared
from massq.operators import spectra as S


def plain_q(rows):
    out, t, d, at = {}, 0, 0, {}
    for score in sorted({s for s, _ in rows}, reverse=True):
        t += sum(1 for s, x in rows if s == score and not x)
        d += sum(1 for s, x in rows if s == score and x)
        at[score] = min(1.0, d / t) if t else 1.0
    least = 1.0
    for score in sorted(at):
        least = min(least, at[score])
        out[score] = least
    return out


def test_q_values_in_one_bucket_and_in_many(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(float(rng.randrange(200)), rng.random() < 0.3) for _ in range(2000)]
    df, want = spark.createDataFrame(rows, "score double, is_decoy boolean"), plain_q(rows)
    for size in (shared.BUCKET_ROWS, 20):
        monkeypatch.setattr(shared, "BUCKET_ROWS", size)
        got = fdr.with_q(df).collect()
        assert len(got) == len(rows) and all(abs(r.q_value - want[r.score]) < 1e-12 for r in got)
    q = sorted((r.score, r.q_value) for r in got)
    assert all(a[1] >= b[1] for a, b in zip(q, q[1:]) if a[0] < b[0])


@pytest.mark.parametrize("rows", [[], [(1.0, False)], [(float("nan"), True), (1.0, False)], [(None, True)]])
def test_q_value_errors(spark, rows):
    with pytest.raises(fdr.FdrError):
        fdr.with_q(spark.createDataFrame(rows, "score double, is_decoy boolean"))


def test_picked_proteins(spark):
    rows = [("a", 5.0), ("REV_a", 3.0), ("b", 2.0), ("REV_b", 2.0), ("c", 1.0), ("REV_c", 4.0), ("d", 0.5)]
    got = {r.leader: r.q_value for r in fdr.picked_q(spark.createDataFrame(rows, "leader string, score double")).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(1 / 3), "d": pytest.approx(1 / 3)} and "c" not in got
    assert {r.q_value for r in fdr.picked_q(spark.createDataFrame(rows[:3], "leader string, score double")).collect()} == {0.0}


def test_ppm_join_is_the_filtered_product(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(100, 110)) for i in range(200)]
    b = [(i, rng.uniform(100, 110)) for i in range(200)] + [(999, 0.0), (998, -5.0)]
    got = joins.ppm_join(spark.createDataFrame(a, "i int, o double"), spark.createDataFrame(b, "j int, t double"), "o", "t", 500).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, o in a for j, t in b if t > 0 and abs(o - t) / t * 1e6 <= 500)


def test_nearest_ties_and_edges(spark):
    left = spark.createDataFrame([(1, "r", 5.0), (2, "r", 50.0), (3, "x", 5.0)], "id int, run string, at double")
    right = spark.createDataFrame([("r", 4.0, 11), ("r", 6.0, 10), ("r", 50.5, 12), ("r", 49.5, 13)], "run2 string, rt double, scan int")
    got = {r.id: r.scan for r in joins.nearest_join(left, right, (("run", "run2"),), "at", "rt", 1.0, ["id"], ["rt", "scan"]).collect()}
    assert got == {1: 11, 2: 13}


def test_digestion_puts_the_protein_together_again(spark):
    rng = random.Random(4)
    rows = [(str(i), "".join(rng.choice(chem.STANDARD) for _ in range(80))) for i in range(10)]
    df = spark.createDataFrame(rows, "accession string, sequence string")
    for enzyme in digest.ENZYMES:
        got = digest.digest(df, enzyme, 0, 1, 1000).groupBy("accession").agg(F.sort_array(F.collect_list(F.struct("ord", "peptide"))).alias("p")).collect()
        assert {r.accession: "".join(x.peptide for x in r.p) for r in got} == dict(rows)
    p = digest.digest(spark.createDataFrame([("a", "AAKPBBKCCRDDK")], "accession string, sequence string"), "trypsin", 0, 1, 50).select("peptide").collect()
    assert [r.peptide for r in p] == ["CCR", "DDK"]  # KP stays, B isn't a residue


def test_decoys_keep_mass_and_layout(spark):
    df = spark.createDataFrame([("a", "PEPTIDEK"), ("b", "K"), ("c", "")], "accession string, sequence string")
    got = {r.accession: r.sequence for r in digest.decoys(df).collect()}
    assert got == {"REV_a": "EDITPEPK", "REV_b": "K", "REV_c": ""}
    one, two = (sorted(map(tuple, digest.decoys(x, "shuffle").collect())) for x in (df, df.repartition(3)))
    assert one == two and sorted(dict(one)["SHUF_a"]) == sorted("PEPTIDEK")


def test_site_combinations(spark):
    mods = (chem.Modification("P", 80.0, "STY"), chem.Modification("Q", 10.0, "S"), chem.Modification("N", 1.0, "", "peptide_nterm"))
    df = spark.createDataFrame([("STAY",)], "p string").withColumn("s", digest.sites(F.col("p"), mods)).withColumn("c", digest.site_combinations(F.col("s"), 2))
    r = df.first()
    s = [tuple(x) for x in r.s]
    want = [c for k in range(3) for c in combinations(s, k) if len({x[1] for x in c}) == len(c)]
    assert sorted(tuple(sorted(tuple(x) for x in c)) for c in r.c) == sorted(tuple(sorted(c)) for c in want) and r.c[0] == []
    d = df.select(F.transform("c", lambda c: digest.combination_deltas(c, F.length("p"), mods)).alias("d")).first().d
    assert all(abs(sum(x) - sum({0: 80.0, 1: 10.0, 2: 1.0}[m] for m, _ in map(tuple, c))) < 1e-9 for x, c in zip(d, r.c))


def greedy(groups):
    left, chosen, rest = {p for ps, _, _ in groups for p in ps}, [], list(groups)
    while left:
        best = min(rest, key=lambda g: (-len(set(g[0]) & left), -g[1], g[2]))
        chosen.append(best[2])
        left -= set(best[0])
        rest.remove(best)
    return set(chosen)


def test_parsimony_equals_the_global_greedy_choice(spark):
    rng = random.Random(6)
    groups = [(sorted(rng.sample(range(60), rng.randint(1, 5))), float(rng.randrange(5)), f"g{i:02d}") for i in range(40)]
    df = spark.createDataFrame([([str(p) for p in ps], s, f, len(ps), [f]) for ps, s, f in groups], "peptides array<string>, score double, first string, size int, members array<string>")
    assert {r["first"] for r in inference.parsimonious(df).collect()} == greedy([([str(p) for p in ps], s, f) for ps, s, f in groups])


def test_subsets_razor_coverage(spark):
    psms = spark.createDataFrame([("AIK", ["A", "B"], 5.0, None), ("CCR", ["A"], 4.0, 0.001), ("DDK", ["C", "A"], 3.0, 0.001), ("EEK", ["C"], 2.0, 0.5), ("FFK", ["C", "REV_D"], 1.0, 0.0)], "peptide string, accessions array<string>, score double, q_value double")
    proteins = spark.createDataFrame([("A", "AIKCCRDDK"), ("C", "XXDDKFFK")], "accession string, sequence string")
    got = {r.leader: r for r in inference.infer(psms, proteins).collect()}
    assert set(got) == {"A", "C"}
    assert got["A"].members == ["A", "B"] and got["A"].unique_peptides == ["ALK", "CCR"] and got["A"].razor_peptides == ["DDK"]
    assert got["C"].members == ["C", "REV_D"] and not got["C"].is_decoy and got["A"].coverage == 1.0 and got["C"].coverage == pytest.approx(6 / 8)


def test_search_finds_what_was_made(spark):
    rng = random.Random(8)
    proteins = [(f"P{i}", "".join(rng.choice("AGVLSTEDNQFY") for _ in range(12)) + "K" + "".join(rng.choice("AGVLSTEDNQFY") for _ in range(10)) + "R") for i in range(12)]
    df = spark.createDataFrame(proteins, "accession string, sequence string")
    peptides = [r.peptide for r in digest.digest(df, missed=0).collect()]
    rows = spark.createDataFrame([theory.spectrum("r", i + 1, p) for i, p in enumerate(peptides)], S.SCHEMA)
    for hyper in (False, True):
        got = {r.scan: r for r in search.search(rows, df, hyperscore=hyper, missed=1, drop_decoys=False).collect()}
        right = sum(got[i + 1].peptide == p for i, p in enumerate(peptides) if i + 1 in got)
        assert right >= len(peptides) - 2
    one = search.matches_within(rows, search.candidates(df, missed=1), 10.0)
    assert one.where("abs(delta_ppm) > 10").count() == 0


def test_search_with_modification(spark):
    df = spark.createDataFrame([("P", "SAMPLEK")], "accession string, sequence string")
    heavy = list(theory.spectrum("r", 1, "SAMPLEK"))
    heavy[4] = [{**heavy[4][0], "mz": heavy[4][0]["mz"] + 15.994915 / 2}]
    got = search.search(spark.createDataFrame([tuple(heavy)], S.SCHEMA), df, variable=(chem.OXIDATION,), decoy="none", shortest=5).collect()
    assert len(got) == 1 and got[0].q_value is None and [tuple(x) for x in got[0].combination] == [(0, 2)]


def test_isotopes(spark):
    step = chem.ISOTOPE_STEP / 2
    ms1 = ("r", 1, 1, 1.0, [], [499.0, 500.0, 500.0 + step, 500.0 + 2 * step, 520.0], [50.0, 100.0, 80.0, 30.0, 90.0], "centroid")
    ms2 = ("r", 2, 2, 1.1, [{"mz": 505.0, "charge": None, "intensity": None, "isolation": {"target": 505.0, "lower": 10.0, "upper": 10.0}, "source_scan": 1}], [100.0], [1.0], "centroid")
    rows = spark.createDataFrame([ms1, ms2], S.SCHEMA)
    found = S.extract_precursors(rows).first().precursors
    assert [(round(p.mz, 3), p.charge, p.source_scan) for p in found] == [(500.0, 2, 1)]
    assert S.correlate(rows).first().method == "source_scan"
    assert S.pseudo_spectra(rows).count() == 2


def test_annotation_and_provenance(spark):
    rows = spark.createDataFrame([theory.spectrum("r", 1, "PEPTIDEK")], S.SCHEMA)
    keyed = rows.select("run", "scan", F.lit("PEPTIDEK").alias("peptide"))
    a = S.annotate(rows, keyed, 10.0, 1, losses=False)
    assert a.count() == 14 and a.where("not matched").count() == 0
    assert S.annotation_scores(a, rows).first().score == 1.0
    other = S.annotate(rows, keyed.withColumn("peptide", F.lit("PEPTLDEK")), 10.0, 1, losses=False)
    p = S.provenance(a, other, rows).first()
    assert p.trap_only == 0 and p.shared > 0 and p.shared_ratio == 1.0 and p.unassigned == 5


def test_levels(spark):
    targets = spark.createDataFrame([("T", "PEPTLDEKANNNNNKGGGGGGGKSAMQQLEK")], "accession string, sequence string")
    c = entrapment.Config(entrapment.Rule(regex="^T"), entrapment.Rule(regex="^Y"))
    index = entrapment.target_index(targets, c)
    traps = spark.createDataFrame([("PEPTLDEK",), ("PEPTIDEK",), ("PEPTLDEQ",), ("ANNNNGGK",), ("WWWWWWWWK",), ("SAMQWLEK",)], "peptide string")
    got = {r.peptide: r for r in entrapment.classify_peptides(traps, index, c).collect()}
    assert {k: v.level for k, v in got.items()} == {"PEPTLDEK": "L0", "PEPTIDEK": "L1", "PEPTLDEQ": "L2", "ANNNNGGK": "L2", "WWWWWWWWK": "L4", "SAMQWLEK": "L3"}
    assert got["PEPTLDEQ"].substitution == "qk" and got["ANNNNGGK"].best_target == "ANNNNNK"


def test_alignment():
    for a, b, d in (("KITTEN", "SITTING", 3), ("AAA", "AAA", 0), ("", "AB", 2), ("AG", "", 2)):
        distance, _, _ = entrapment.align(a, b)
        assert distance == d == entrapment.align(b, a)[0]
    assert entrapment.align("ANK", "AGGK")[2] == pytest.approx(0.0, abs=1e-5)


def test_expressions(spark):
    df = spark.range(1)
    at = lambda c: df.select(c).first()[0]
    lit = F.lit
    assert at(X.within_ppm(lit(100.0009), lit(100.0), 10.0)) and not at(X.within_ppm(lit(1.0), lit(0.0), 10.0)) and at(X.delta_ppm(lit(1.0), lit(0.0))) == 0
    assert at(chem.residue_mass(lit("B"))) is None and at(chem.residue_mass(lit("B"), rounded=True)) == 0
    assert at(chem.peptide_mass(lit("PEPTIDE"))) == pytest.approx(theory.mass("PEPTIDE")) and at(chem.peptide_mass(lit("PEPXIDE"))) is None
    assert at(X.isobaric_dipeptide(lit("ANK"), lit("AGGK"))) == "N" and at(X.isobaric_dipeptide(lit("QK"), lit("GAK"))) == "Q" and at(X.isobaric_dipeptide(lit("NK"), lit("AGK"))) is None
    assert at(X.family_name(lit("sp|P1|ALBU_HUMAN"))) == "ALBU" and at(X.family_name(lit("x;y"))) == "x"
    b, y = at(chem.b_ions(lit("PEK"))), at(chem.y_ions(lit("PEK")))
    assert sorted(b + y) == pytest.approx(theory.fragments("PEK"))
    with pytest.raises(Exception, match="charge"):
        at(chem.mz(lit(100.0), lit(0)))


def test_centroids_against_numpy(spark):
    from massq.sources.spectra import picked

    rng = np.random.default_rng(3)
    mz, y = np.arange(1.0, 60.0), rng.random(59)
    want = picked(mz, y)
    got = spark.createDataFrame([(mz.tolist(), y.tolist())], "m array<double>, y array<double>").select(S.centroids(F.col("m"), F.col("y"))).first()[0]
    assert [p.mz for p in got] == pytest.approx(want[0]) and [p.intensity for p in got] == pytest.approx(want[1])


def test_centroids_of_little_or_nothing(spark):
    """Null arrays, empty ones and two points have no inner maximum; of a plateau the first point counts; least is a share of the largest."""
    rows = [(None, None), ([], []), ([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0, 3.0, 4.0], [1.0, 5.0, 5.0, 1.0]), ([1.0, 2.0, 3.0, 4.0, 5.0], [0.0, 1.0, 0.0, 9.0, 0.0])]
    df = spark.createDataFrame(rows, "m array<double>, y array<double>").coalesce(1)
    found = [x.p for x in df.select(S.centroids(F.col("m"), F.col("y"), 0.5).alias("p")).collect()]
    assert [[p.intensity for p in f] for f in found] == [[], [], [], [5.0], [9.0]]
    assert found[4][0].mz == 4.0



def test_advice(spark):
    with pytest.raises(ValueError):
        advice.Params(missed=6)
    d = advice.recommend({"median_peaks": 20, "mz_max": 1000, "median_window": 25}, {"acquisition": "DDA"})
    assert d.params.fragment_unit == "Da" and d.conflicts and advice.recommend({}, None).params == advice.Params()
    assert len(advice.merge_mods(d.params.variable, (chem.OXIDATION, advice.PHOSPHO))) == 2
    row = spark.createDataFrame([(0, 0, 0.0, 10.0, 1.0, 2.0)], "psms long, decoys long, id_rate double, tolerance_ppm double, matching_sec double, total_sec double")
    assert [r.anomaly for r in advice.diagnose(row).collect()] == ["NoDecoyHits", "NoPsms", "VeryLowIdRate"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_similar_join_equals_the_full_product(spark, most):
    """Texts of 0 to 12 letters, short ones too, with a null among them."""
    rng = random.Random(most)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 12) if k % 3 else rng.randint(0, 4))) for k in range(170)})
    left, right = words[::2] + ["ab"], words[1::2] + ["ab", "abc"]
    of = lambda name, values: spark.createDataFrame([(v,) for v in [*values, None]], f"{name} string")
    for slack in (1, most):
        got = {(r.a, r.b_similar, r.distance) for r in joins.similar_join(of("a", left), of("b", right), "a", "b", most, slack).collect()}
        assert got == {(x, y, d) for x in left for y in right if x != y and abs(len(x) - len(y)) <= slack and (d := _distance(x, y)) <= most}


@pytest.mark.parametrize("most", [0, 1, 3])
def test_hamming_join_equals_the_full_product(spark, most):
    rng = random.Random(most)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 9) if k % 3 else rng.randint(0, 4))) for k in range(150)})
    left, right = words[::2] + ["ab"], words[1::2] + ["ab", "ab"]
    of = lambda name, values: spark.createDataFrame([(v,) for v in [*values, None]], f"{name} string")
    got = sorted((r.a, r.b_similar, r.mismatches) for r in joins.hamming_join(of("a", left), of("b", right), "a", "b", most).collect())
    assert got == sorted({(x, y, n) for x in left for y in right if x != y and len(x) == len(y) and (n := sum(p != q for p, q in zip(x, y, strict=True))) <= most})


def test_parsimony_in_rounds_equals_one_task(spark):
    """A hot peptide that all groups hold, so all of them are one component."""
    rng = random.Random(9)
    groups = [(sorted({0, *(rng.randrange(1, 60) for _ in range(rng.randint(1, 6)))}), float(rng.randint(1, 3)), f"g{k:03d}") for k in range(80)]
    df = spark.createDataFrame([([f"{p:03d}" for p in ps], s, f) for ps, s, f in groups], "peptides array<string>, score double, first string")
    want = greedy([([f"{p:03d}" for p in ps], s, f) for ps, s, f in groups])
    assert {r["first"] for r in inference.parsimonious(df).collect()} == want
    assert {r["first"] for r in inference.parsimonious(df, local=0).collect()} == want


def test_search_in_dalton(spark):
    """An open search takes every candidate within 500 of the precursor's m/z, whatever its mass."""
    peptides = spark.createDataFrame([("A", 500.5), ("B", 1990.0), ("C", 2998.0), ("D", 3004.0)], "peptide string, mass double")
    one = "struct<mz:double,charge:int,intensity:double,isolation:struct<target:double,lower:double,upper:double>,source_scan:int>"
    spectra = spark.createDataFrame([("r", 1, 2, [(1001.007276, 2, None, None, None)]), ("r", 2, 2, [(1001.007276, 1, None, None, None)])], f"run string, scan int, ms_level int, precursors array<{one}>")
    found = {(r.scan, r.peptide) for r in search.matches_within(spectra, peptides, 500.0, "Da").collect()}
    assert found == {(1, "B"), (1, "C"), (2, "A")}
    assert {(r.scan, r.peptide) for r in search.matches_within(spectra, peptides, 5.01, "Da").collect()} == {(1, "B")}


def test_a_batch_played_again_changes_nothing(spark, tmp_path):
    from massq.streaming import events

    write, rows = events.sink(str(tmp_path)), spark.range(5)
    for number in (0, 1, 0, 1, 1):
        write(rows, number)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 10
