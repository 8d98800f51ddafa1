from conftest_llm import LOWER, words

from massq.llm import near
from massq.operators.graph import components


def test_classes_against_all_pairs(docs, rows):
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    want = sorted(((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in near.classes(docs).collect()), key=repr)
    assert got == want


def test_one_of_each_class_stays(docs):
    kept = near.drop_near_duplicates(docs)
    again = near.classes(kept.dropDuplicates(["doc_id"]))
    assert kept.columns == docs.columns and again.where("not kept").count() == 0


def test_crowded_region_is_divided():
    import numpy as np

    shared = np.array([0] + [near.DEPTH] * 999 + [5] * 400 + [0, 3])
    found = list(near.regions(shared))
    assert all(0 < b - a <= near.REGION for a, b in found)
    assert (1400, 1402) in found and {i for a, b in found for i in range(a, b)} >= set(range(1000))


def test_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


def test_empty(none):
    assert near.classes(none).count() == 0


def families(spark, size):
    """Two families of ``size`` variants: 0.99 inside, 0.877 between."""
    first = [f"w{i}" for i in range(400)]
    second = [f"x{i}" if i % 80 == 40 else w for i, w in enumerate(first)]
    return spark.createDataFrame([(k, " ".join([*(first, second)[k % 2], f"end{k}"])) for k in range(2 * size)], "doc_id long, text string")


def test_families_that_are_linked_with_each_other(spark):
    found = near.classes(families(spark, 20)).collect()
    assert len(found) == 40 and {x.component_id for x in found} == {0}


def test_crowded_spot_is_dealt_in_pairs_of_blocks(spark):
    from itertools import combinations

    for big in (0, 1700):
        rows = spark.range(2000).selectExpr("1L AS spot", "2000L AS m", "cast(cast(id AS string) AS binary) AS vid", f"if(id < {big}, -1L, id) AS comp", f"if({big} > 0, -1L, null) AS most", f"if({big} > 0, {big}L, null) AS big")
        tasks = {}
        for x in near.in_blocks(rows).collect():
            tasks.setdefault((x.lo, x.hi), []).append((x.block, bytes(x.vid)))
        met = [(min(x, y), max(x, y)) for (lo, hi), held in tasks.items() for (i, x), (j, y) in combinations(held, 2) if lo == hi or i != j]
        assert max(map(len, tasks.values())) < 3 * near.BLOCK and len(met) == len(set(met)) == 2000 * 1999 // 2 - big * (big - 1) // 2


def test_crowd_of_two_families(spark):
    assert {x.component_id for x in near.classes(families(spark, 300)).collect()} == {0}


def test_copies_at_four_fifths_are_dropped(spark):
    first = [f"w{i}" for i in range(400)]
    second = [f"x{i}" if i % 47 == 40 else w for i, w in enumerate(first)]  # 8 changed words: 356 of 436 shingles
    docs = spark.createDataFrame([(0, " ".join(first)), (1, " ".join(second))], "doc_id long, text string")
    assert near.drop_near_duplicates(docs).count() == 1 and near.classes(docs).where("kept").count() == 2


def test_ids_that_repeat_or_are_missing(spark):
    text = lambda name, end="": " ".join([*(f"{name}{i}" for i in range(100)), end])
    rows = [(3, text("a")), (5, text("b")), (5, text("a", "x")), (6, text("c")), (6, text("c")), (None, text("d")), (None, text("d", "x")), (None, text("d", "y")), (None, text("e")), (None, text("b", "x")), (7, ""), (7, text("a", "y")), (None, None), (8, text("a", "z"))]
    got = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = sorted((str(x.doc_id), (x.text or " ")[:1]) for x in got)
    assert of == sorted([("3", "a"), ("5", "b"), ("6", "c"), ("None", "d"), ("None", "e"), ("7", " "), ("None", " ")])


def all_pairs(texts, percent):
    """Smallest place in each text's component, from all pairs."""
    sets = [set(near.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_crowded_regions_against_all_pairs(spark):
    """Three dense groups of some 120 in the same spots, of which two are linked by few pairs and one by none; on 2 and on 7 partitions."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    bases = [base, [f"x{i}" if i < 9 else w for i, w in enumerate(base)], [f"y{i}" if i < 40 else w for i, w in enumerate(base)]]
    texts = []
    for k in range(360):
        words = list(bases[k % 3])
        for _ in range(1 + k % 2):
            words[rng.randrange(60, 200)] = f"z{k}"
        texts.append(" ".join(words))
    want = all_pairs(texts, 85)
    assert 1 < len(set(want)) < 20
    rows, before = [(i, t) for i, t in enumerate(texts)], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {x.doc_id: x.component_id for x in near.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
            assert [got[i] for i in range(len(texts))] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_vertex_with_most_rows(spark):
    """Hot copies, rows without words, and a text of its own: the same whichever side is broadcast."""
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, text if i < 3000 else None if i < 3100 else f"{text} a{i}" if i < 3103 else "other words") for i in range(3104)], "doc_id long, text string")
    got = {x.doc_id: (x.component_id, x.kept) for x in near.classes(docs).collect()}
    assert got == {i: (0, i == 0) if i < 3000 or 3100 <= i < 3103 else (i, True) for i in range(3104)}
    assert sorted(x.doc_id for x in near.drop_near_duplicates(docs).collect()) == [0, *range(3000, 3100), 3103]
