"""Work that grows with the input and not with its square: copies of a table's rows meet once."""

import random

import pytest
from pyspark.sql import functions as F

from massq.functions import chem
from massq.operators import digest, engine, inference, joins, search, shared
from massq.operators import spectra as S
from massq.plans import engine as plans
from massq.plans import matching, proteins
from massq.sources import results


@pytest.fixture
def tables(spark, monkeypatch):
    """Tables by name in place of files."""
    found = {}
    for module in (matching, plans):
        monkeypatch.setattr(module, "table", lambda spark, d, name: found[name])
    return found


def priced(spark, found, copies):
    part = [(k * 100 + c, 900.0 + k / 10) for k in range(5) for c in range(copies)]
    found["part"] = spark.createDataFrame(part, "p_partkey long, p_retailprice double")
    lines = [(k, 1, k, 2.0, 2 * (900.0 + k / 50), "R" if k % 3 else "A", "F") for k in range(20)]
    found["lineitem"] = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string")


def test_parts_of_one_price_meet_a_line_once(spark, tables):
    priced(spark, tables, 1)
    few, best = matching.scored_candidates(spark, "", 200).count(), sorted(map(tuple, matching.best_match(spark, "").collect()))
    priced(spark, tables, 40)
    assert matching.scored_candidates(spark, "", 200).count() == few
    assert sorted(map(tuple, matching.best_match(spark, "").collect())) == best and len(best) == 20


def test_a_dictionary_is_read_in_tasks(spark, tmp_path, monkeypatch):
    one = lambda k: f'<umod:mod record_id="{k}" title="t {k} a:b"><umod:specificity site="N-term"/><umod:specificity site="S"/><umod:delta mono_mass="{k}.5"/></umod:mod>'
    (tmp_path / "u.xml").write_text('<?xml version="1.0" encoding="UTF-8"?>\n<umod:unimod xmlns:umod="u"><umod:mod record_id="0" title="bare"/>' + "\n".join(map(one, range(1, 300))) + '<umod:mod record_id="0" title="bare"/></umod:unimod>\n')
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", None)  # nothing meets in the driver
    rows = results.unimod(spark, f"file://{tmp_path}/u.xml")
    monkeypatch.undo()
    found = rows.toPandas().sort_values("id")
    assert found.id.tolist() == list(range(1, 300)) and found.title[4] == "t 5 a:b" and found.mass[4] == 5.5 and set(found.residues) == {"S"}


def test_equal_compositions_have_equal_masses(spark):
    made = lambda p: [i.mz for i in spark.createDataFrame([(p,)], "p string").select(F.inline(chem.theoretical_ions(F.col("p"), None, 1))).collect()]
    letters = "GSTVLNDQKEMHFRYW"
    one, other = made(letters + "K"), made(letters[::-1] + "K")
    assert one[len(letters) - 1] == other[len(letters) - 1]  # the same residues before the last, in two orders
    total = 0.0
    for residue, mass in chem.RESIDUES.items():
        total += letters.count(residue) * mass
    assert one[len(letters) - 1] == total + chem.PROTON


def test_equal_masses_are_paired_once(spark, tables, monkeypatch):
    rows, plain = [], joins.ppm_join

    def counted(*args, **more):
        rows.append((out := plain(*args, **more)).count())
        return out

    monkeypatch.setattr(engine, "ppm_join", counted)
    priced(spark, tables, 1)
    once = {r.isotope_error: r for r in plans.isotope_pairs(spark, "").collect()}
    priced(spark, tables, 7)
    found = {r.isotope_error: r for r in plans.isotope_pairs(spark, "").collect()}
    assert rows[0] == rows[1] and once and {k: (r.n, r.parts, r.orders) for k, r in found.items()} == {k: (7 * r.n, 7 * r.parts, 7 * r.orders) for k, r in once.items()}


def test_a_median_meets_in_no_single_task(spark, monkeypatch):
    rows = spark.createDataFrame([(float(k % 7) if k % 5 else None, k) for k in range(101)], "v double, k long")
    monkeypatch.setattr(shared, "BUCKET_ROWS", 2)
    for some in (rows, rows.where("k < 50"), rows.where("v is null"), rows.where("k < 2")):
        assert shared.median(some, "v", "m").first().m == some.agg(F.median("v")).first()[0]


def test_enzymes_share_one_pass_over_the_texts(spark, monkeypatch):
    monkeypatch.setattr(proteins, "table", lambda spark, d, name: spark.createDataFrame([(1, "MKPR TEXDK"), (1, "AAK"), (2, None), (3, "XX")], "doc_id long, text string"))
    found = proteins.digest_enzymes(spark, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    one = {r.enzyme: (r.n, r.longest) for r in found.where("accession = '1'").collect()}
    assert one["trypsin"] == (2, 4) and one["custom"] == (1, 3) and found.where("accession <> '1'").count() == 0


def test_peaks_of_one_mass_are_one(spark):
    spectra = spark.createDataFrame([("r", 1, [100.0, 100.0, 200.0])], "run string, scan int, mz array<double>")
    claims = spark.createDataFrame([("r", 1, 100.0, True, c) for c in ("trap", "a")], "run string, scan int, observed_mz double, matched boolean, candidate string")
    found = S.multi_provenance(claims, spectra).first()
    assert (found.shared, found.unassigned, found.most_candidates) == (1, 1, 2)


def test_a_chain_of_groups_needs_no_round_each(spark, monkeypatch):
    rows, plain = [], inference.materialise
    monkeypatch.setattr(inference, "materialise", lambda df: rows.append(out := plain(df)) or out)
    # Each shares a peptide with the next, all share one, and each comes before the next.
    sets = [[f"{k}_{i}" for i in range(60 - 2 * k)] + [f"link{k}", f"link{k + 1}", "all"] for k in range(25)] + [["link3", "all"], ["link9"]]
    groups = spark.createDataFrame([(p, 1.0, f"g{k:02d}") for k, p in enumerate(sets)], "peptides array<string>, score double, first string")
    assert {r["first"] for r in inference.parsimonious(groups, local=0).collect()} == {f"g{k:02d}" for k in range(25)}
    assert len(rows) < 10


def test_equal_gains_go_by_score_then_name(spark):
    sets = [("b", 2.0, "xy"), ("a", 1.0, "xyz"), ("c", 2.0, "zx"), ("d", 2.0, "yz"), ("e", None, "uv"), ("f", 9.0, "uv")]
    groups = spark.createDataFrame([(list(p), s, f) for f, s, p in sets], "peptides array<string>, score double, first string")
    for local in (0, 100):
        assert {r["first"] for r in inference.parsimonious(groups, local=local).collect()} == {"a", "e"}  # a null score comes first


def test_groups_with_a_peptide_of_their_own_meet_no_superset(spark, monkeypatch):
    """Only shared peptides are written for groups to meet on; hits that come twice change nothing."""
    rows, plain = [], inference.materialise
    monkeypatch.setattr(inference, "materialise", lambda df: rows.append(out := plain(df)) or out)
    sets = {"a": "xyzu", "b": "xyw", "c": "xy", "d": "y", "e": "vq", "f": "xyz"}
    hits = spark.createDataFrame([(p, 1.0, name) for name, ps in sets.items() for p in ps * 2], "peptide string, score double, protein string")
    found = {r["sub"]: r["super"] for r in inference.subset_links(inference.indistinguishable(hits)).collect()}
    assert found == {"c": "a", "d": "a", "f": "a"} and rows[0].count() == 11


def test_a_peptide_is_joined_and_weighed_once(spark):
    """Whatever is asked of a peptide, its pieces are joined in one place of the plan, and its mass isn't taken of every occurrence."""
    texts = spark.createDataFrame([("a", "AAGKCCDRPEEKFFK"), ("b", None), ("c", ""), ("d", "AAGKXXK")], "accession string, sequence string")
    rows = digest.digest(texts, missed=2, shortest=3).where(F.length("peptide") % 2 == 1)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_join") == 1
    found = {(r.ord.missed, r.ord.place, r.peptide, r.is_protein_nterm, r.is_protein_cterm) for r in rows.where("accession = 'a'").collect()}
    assert found == {(0, 3, "FFK", False, True), (1, 2, "CCDRPEEKFFK", False, True), (2, 1, "AAGKCCDRPEEKFFK", True, True)}
    assert rows.where("accession <> 'a'").count() == 0
    plan = search.candidates(texts, missed=0, shortest=3).where("mass > 300")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("> 300") < plan.index("Aggregate") and "translate" not in plan and plan.count("EvalPython") == 1


def test_masses_in_batches_equal_those_by_row(spark):
    texts = ["GAVLIPFWMSTCYHDENQKR" * 2, "KKKRGGAVLLMMC", "", None, "PEPTXDE", "pep", "é", "R"]
    row = spark.createDataFrame([(t,) for t in texts], "p string").select(chem.peptide_masses(F.col("p")).alias("a"), chem.peptide_mass(F.col("p")).alias("b")).collect()
    assert [r.a for r in row] == [r.b for r in row] and row[2].a == chem.WATER and row[3].a is None and row[4].a is None


def test_running_sums_are_those_of_adding_residues(spark):
    rows = [("MKWVTFISLLR", [(0, -1), (1, 3), (0, 11)]), ("PEPTIDEKPEPTIDER", []), ("A", [(1, 0)]), ("", []), ("GGGGGGGGGGGGGGGGGGGGGK", [(1, 20), (1, 20)])]
    frame = spark.createDataFrame(rows, "p string, c array<struct<mod:int,pos:int>>")
    masses, deltas = {k: v + (57.021464 if k == "C" else 0.0) for k, v in chem.RESIDUES.items()}, (42.010565, 15.994915)
    got = [r.s for r in frame.select(chem.residue_prefixes(F.col("p"), F.col("c"), masses, 229.1, 0.5, deltas).alias("s")).collect()]
    for (p, c), sums in zip(rows, got, strict=True):
        want, total = [], 0.0
        for i, x in enumerate(p):
            more = 0.0
            for mod, pos in c:
                more += deltas[mod] if min(max(pos, 0), len(p) - 1) == i else 0.0
            total += masses[x] + (229.1 if i == 0 else 0.0) + (0.5 if i == len(p) - 1 else 0.0) + more
            want.append(total)
        assert sums == want


def test_a_large_gain_among_many_groups_stays_a_number(spark):
    """Gains times groups pass 32 bits: one group holds a peptide of each of the first 45,000, the others have their own."""
    large = spark.range(45_000).agg(F.collect_list(F.concat(F.lit("p"), "id")).alias("peptides"), F.lit(9.0).alias("score"), F.lit("large").alias("first"))
    small = spark.range(50_000).select(F.array(F.concat(F.lit("p"), "id")).alias("peptides"), F.lit(1.0).alias("score"), F.format_string("g%05d", "id").alias("first"))
    found = inference.parsimonious(large.union(small), local=0)
    assert found.agg(F.count(F.lit(1)), F.min("first"), F.max("first")).first() == (5001, "g45000", "large")


def test_a_peptide_alone_meets_no_holders(spark, monkeypatch):
    """Its largest holder is found where holders are counted; ties go by name, and sets of two still meet."""
    rows, plain = [], inference.materialise
    monkeypatch.setattr(inference, "materialise", lambda df: rows.append(out := plain(df)) or out)
    sets = {"a": "x", "b": "xyz", "c": "xyw", "d": "xy", "e": "q", "f": "v", "g": "vu"}
    groups = inference.indistinguishable(spark.createDataFrame([(p, 1.0, name) for name, ps in sets.items() for p in ps], "peptide string, score double, protein string"))
    found = {r["sub"]: r["super"] for r in inference.subset_links(groups).collect()}
    assert found == {"a": "b", "d": "b", "f": "g"}
    assert {(r["first"], r["super"]) for r in rows[0].where("super is not null").collect()} == {("a", "b"), ("f", "g")}
    kept = {r["first"]: r.members for r in inference.without_subsets(groups).collect()}
    assert kept == {"b": ["a", "b", "d"], "c": ["c"], "e": ["e"], "g": ["f", "g"]}


def test_razor_peptides_meet_again_only_where_a_group_has_its_own(spark, monkeypatch):
    rows, plain = [], inference.materialise
    monkeypatch.setattr(inference, "materialise", lambda df: rows.append(out := plain(df)) or out)
    sets = [("a", 1.0, "xyz"), ("b", 2.0, "xyw"), ("c", 2.0, "zwx"), ("d", None, "zy")]
    groups = lambda sets: spark.createDataFrame([(list(p), s, n) for n, s, p in sets], "peptides array<string>, score double, leader string")
    assert {r.peptide: r.leader for r in inference.razor(groups(sets)).collect()} == {"x": "b", "y": "d", "z": "d", "w": "b"}  # a null score comes first
    assert [r.count() for r in rows] == [4, 0]  # a row a peptide, and no group to look at again
    sets += [("e", 0.5, "xuv"), ("f", 0.1, "yt"), ("g", 9.0, "ys")]
    assert {r.peptide: r.leader for r in inference.razor(groups(sets)).collect()} == {"x": "e", "y": "g", "z": "d", "w": "b"}
    named = groups(sets).withColumn("members", F.array("leader")).withColumn("first", F.col("leader"))
    built = {r.leader: (r.unique_peptides, r.razor_peptides) for r in inference.build_groups(named).collect()}
    assert built == {"a": ([], []), "b": ([], ["w"]), "c": ([], []), "d": ([], ["z"]), "e": (["u", "v"], ["x"]), "f": (["t"], []), "g": (["s"], ["y"])}


def test_groups_of_low_gain_wait_until_high_gains_are_covered(spark, monkeypatch):
    """Rounds write the groups that may come next, not all: 600 groups, few of them large."""
    rows, plain = [], inference.materialise
    monkeypatch.setattr(inference, "materialise", lambda df: rows.append(out := plain(df)) or out)
    rng = random.Random(7)
    sets = {f"g{k:03d}": rng.sample(range(150), rng.choice([2, 2, 2, 2, 2, 3, 6])) for k in range(600)}
    groups = spark.createDataFrame([([str(p) for p in ps], 1.0, name) for name, ps in sets.items()], "peptides array<string>, score double, first string")
    want, left = set(), set(range(150))
    while left:
        best = min(sets, key=lambda name: (-len(left & set(sets[name])), name))
        want.add(best)
        left -= set(sets[best])
    for local in (100, 0):
        rows.clear()
        assert {r["first"] for r in inference.parsimonious(groups, local=local).collect()} == want
        assert sum(r.count() for r in rows) < 5000
