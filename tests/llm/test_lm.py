import math
from collections import Counter

import numpy as np
import pytest
from conftest_llm import LOWER, remainder, words

from massq.llm import lm


@pytest.fixture(scope="module", autouse=True)
def small_blocks():
    old = lm.BLOCK
    lm.BLOCK = 2000
    yield
    lm.BLOCK = old


def test_against_plain_counts(docs, rows):
    texts = [(r[0], [*words((r[1] or "").translate(LOWER)), None]) for r in rows]
    fold = {d: remainder(d, lm.FOLDS) for d, _ in texts}
    one, two, three = Counter(), Counter(), Counter()
    kept_one, kept_two, kept_three = Counter(), Counter(), Counter()
    for d, w in texts:
        pairs, triples = list(zip([None, *w], w, strict=False)), list(zip([None, *w], w, w[1:], strict=False))
        if fold[d] != lm.HELD:
            one.update(w), two.update(pairs), three.update(triples)
        if fold[d] not in (lm.HELD, lm.DELETED):
            kept_one.update(w), kept_two.update(pairs), kept_three.update(triples)
    n, v, kept = sum(one.values()), len(one), sum(kept_one.values())
    step = lambda p: min(round(-4 * math.log2(p)), lm.STEPS - 2) if p > 0 else lm.STEPS - 1
    bucket = lambda c: min(int(2 * math.log2(c + 1)), lm.BUCKETS - 1)
    part = lambda a, b: a / b if b else 0

    def learned(cells, *low):
        return lm.learn_weights(np.array(list(cells)), np.array(list(cells.values()), float), *low)

    def lower(a, b, one, two, n):
        x = weights[bucket(one[a])]
        return x[0] * part(two[a, b], one[a]) + x[1] * one[b] / n + x[2] / (v + 1)

    cells = Counter()
    for d, w in texts:
        if fold[d] == lm.DELETED:
            for a, b in zip([None, *w], w, strict=False):
                c = kept_one[a]
                cells[(bucket(c) * lm.STEPS + step(part(kept_two[a, b], c))) * lm.STEPS + step(kept_one[b] / kept)] += 1
    weights = learned(cells, 1 / (v + 1))
    cells = Counter()
    for d, w in texts:
        if fold[d] == lm.DELETED:
            for a, b, c in zip([None, *w], w, w[1:], strict=False):
                cells[(bucket(kept_two[a, b]) * lm.STEPS + step(part(kept_three[a, b, c], kept_two[a, b]))) * lm.STEPS + step(lower(b, c, kept_one, kept_two, kept))] += 1
    top = learned(cells)
    assert any(top[:, 0] > 0.05)
    want = []
    for d, w in texts:
        base = sum(math.log10((one[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)
        score = math.log10(lower(None, w[0], one, two, n))
        for a, b, c in zip([None, *w], w, w[1:], strict=False):
            x = top[bucket(two[a, b])] if two[a, b] else [0, 1]
            score += math.log10(x[0] * part(three[a, b, c], two[a, b]) + x[1] * lower(b, c, one, two, n))
        want.append((repr(d), fold[d] == lm.HELD, len(w), sum(one[t] > 0 for t in w), n, base, score))
    got = [(repr(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in lm.score(docs).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_weights_sum_to_one_and_follow_the_data():
    cells = np.array([(5 * lm.STEPS + 4) * lm.STEPS + 40, (1 * lm.STEPS + lm.STEPS - 1) * lm.STEPS + 20])
    w = lm.learn_weights(cells, np.array([1000.0, 1000.0]), 1e-6)
    assert np.allclose(w.sum(axis=1), 1) and w[5, 0] > 0.9 and w[1, 1] > 0.9


def test_packing():
    for kind in (np.uint32, np.uint64):
        x = np.random.default_rng(1).integers(0, 1 << 31, 1000).astype(kind)
        assert (lm._unpack(lm._pack(x), kind) == x).all()
    assert len(lm._unpack(lm._pack(np.empty(0, np.uint32)), np.uint32)) == 0


def test_empty_and_untrained(spark, none):
    assert lm.score(none).count() == 0
    held = next(i for i in range(1000) if remainder(i, lm.FOLDS) == lm.HELD)
    x = lm.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).first()
    assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (3, 0, 0, True)


def test_word_order_counts(spark):
    """Held-out texts of the same words and nearly the same pairs: the one that training documents hold scores higher."""
    rng = np.random.default_rng(3)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(12)], 40))
    known, other = text(), text()
    held = [i for i in range(1000) if remainder(i, lm.FOLDS) == lm.HELD][:2]
    taught = [i for i in range(1000) if remainder(i, lm.FOLDS) != lm.HELD][:300]
    rows = [(held[0], known), (held[1], other), *[(i, known if k % 10 == 0 else text()) for k, i in enumerate(taught)]]
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()}
    assert got[held[0]].n_known == got[held[1]].n_known == 41
    assert got[held[0]].score > got[held[1]].score + 5
