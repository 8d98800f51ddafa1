from collections import defaultdict

from conftest_llm import words

from massq.llm import mixing


def filled(sizes, weights, most=3):
    """Targets by the rule itself: share out, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = float(most * sizes[s])
            left -= capped[s]
        if not set(names) - set(capped):
            return capped


def test_targets_and_whole_documents(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, source = defaultdict(int), {r[0]: r[3] for r in rows}
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, taken, largest = filled(sizes, (5, 2, 1)), defaultdict(int), defaultdict(int)
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[s] += x.taken
        largest[s] = max(largest[s], x.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * largest[s]
    assert sorted(got, key=repr) == sorted(mixing.mix(docs.repartition(3)).collect(), key=repr)


def test_taking_keeps_columns_and_repeats(docs):
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(x.taken // x.size for x in mixing.mix(docs).where("size > 0").collect()) + taken.where("trim(coalesce(text, '')) = '' or text rlike '^[ \\n\\t]*$'").count()


def test_names_that_clash(docs):
    clash = docs.selectExpr("doc_id", "text", "source", "1 AS _mix_key", "'k' AS _mix_copy", "2 AS row", "'c' AS col")
    taken = mixing.take_mix(clash)
    assert taken.columns == clash.columns
    assert sorted(map(tuple, taken.collect()), key=repr) == sorted(((*r, 1, "k", 2, "c") for r in mixing.take_mix(docs).select("doc_id", "text", "source").collect()), key=repr)


def test_empty(none):
    assert mixing.mix(none).count() == 0 and mixing.take_mix(none).count() == 0
