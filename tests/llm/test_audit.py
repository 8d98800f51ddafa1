import re
from itertools import permutations

import pytest

from massq.llm import audit


def plain(rows, labels):
    """Every order applied to every row."""
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts[r[1] or ""] = min(r[0], texts.get(r[1] or "", r[0]))
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or t == 1)
    seen = []
    for r in rows:
        t = r[1] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and t in texts and r[0] > texts[t]}
        seen.append((r[2] or "", {k for k, v in fails.items() if v}, *(marks.get(r[0], (False, False)) if r[0] is not None else (False, False))))
    out = {}
    for part in {x[0] for x in seen}:
        mine, all_removed = [x for x in seen if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, redundant = [x for x in left if f in x[1]], sum(f in x[1] for x in mine) - sum(f in x[1] for x in left)
                left = [x for x in left if f not in x[1]]
                all_removed[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(all_removed[f])
    return out


def test_all_orders(spark, docs, rows):
    labels = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 200, 2)] + [(4, 1, None), (None, 1, 1), (6, None, 1)]
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(rows, labels)
    assert len(got) == len(want) == 120 * 5 * len({r[2] or "" for r in rows})
    for x in got:
        assert [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] == want[x.part, x.filter_order, x.step]


def test_paths():
    reaching, leaving = audit.path_counts(5)
    assert reaching[31] == leaving[0] == 120 and reaching[0b101] == 2 and leaving[0b101] == 6


def test_other_filters_and_orders(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tests = lambda text, words: {"short": audit.F.size(words) < 50, "mark": text.contains("!")}
    found, names = audit.cells(docs, none, tests, None, part_col="source")
    got = audit.steps(audit.edges(found, 2), names, [("mark", "short")]).where("step = 2").collect()
    for x in got:
        mine = [r for r in rows if (r[3] or "") == x.part]
        assert x.kept == sum(len((r[1] or "").split()) >= 50 and "!" not in (r[1] or "") for r in mine)
        assert x.redundant == sum(len((r[1] or "").split()) < 50 and "!" in (r[1] or "") for r in mine)
    with pytest.raises(ValueError):
        audit.cells(docs, none, lambda t, w: {str(k): t == "" for k in range(8)})


def test_empty(spark, none):
    assert audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
