import random
import re
from collections import Counter

import pytest

from massq.llm import phrases
from conftest_llm import LOWER, SCHEMA


def plain(rows, most=3, least=10, top=2000, held=50):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r[1] or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if not any(la == lang and len(q) > len(p) and 100 * b >= held * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (la, q), b in found.items()):
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, k, *x[1:]) for k, x in enumerate(mine, 1)]
    return ranked


def same(df, want):
    assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in df.collect()) == sorted(want)


@pytest.mark.parametrize(("most", "least", "top", "spread"), [(3, 10, 2000, phrases.SPREAD), (3, 4, 20, 50), (2, 3, 2000, 10), (4, 4, 2000, 30)])
def test_against_plain_counts(docs, rows, most, least, top, spread):
    want = plain(rows, most, least, top)
    assert want
    same(phrases.collocations(docs, most, least, top, spread=spread), want)


def test_blocks_and_their_ends(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "c", "d.", "e", "\tf", "G"]) for _ in range(rng.randint(0, 90))), rng.choice(["x", "y", None])) for i in range(40)]
    monkeypatch.setattr(phrases, "BLOCK", 50)  # counts in this process
    texts = {"lang": [r[2] or "und" for r in rows], "text": [r[1].encode() for r in rows]}
    import pyarrow as pa

    seen = Counter()
    for lang, names, ids, n in phrases._blocks(iter([pa.record_batch(texts)]), 3):
        found, counts = phrases.windows(ids, len(names), n, 3)
        assert n <= 200
        for w, c in zip(found.tolist(), counts.tolist(), strict=True):
            seen[lang, tuple(names[k] for k in w if k)] += c
    want = Counter()
    for r in rows:
        for piece in re.split("[.,;:!?\n-\r]", r[1].translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for i in range(len(w)):
                want[r[2] or "und", tuple(x.encode() for x in w[i : i + 3])] += 1
    assert seen == want


def test_folding_keeps_the_sum():
    seen = Counter({b"a b": 9, b"a c": 2, b"d": 3, b"": 4, b"e f": 10})
    assert phrases.folded(seen, 10) == Counter({b"e f": 10, b"a": 11, b"": 7})
    assert phrases.folded(Counter({b"a b": 9}), 10) == Counter({b"": 9})


def test_exact_scores(spark):
    a, l, r = 3 * 10**12 + 7, 4 * 10**12 + 1, 5 * 10**12 + 3
    df = spark.createDataFrame([(a, l, r), (10, 10, 10)], "a long, l long, r long").withColumn("s", phrases._score("a", "l", "r"))
    assert [x.s for x in df.collect()] == [10**6 * a * a // (l * r), 10**6]


def test_marks_ties_and_bytes(spark):
    rows = [(k, t, lang, "s", 1, "x", "y", "z", 1, 2, 3) for k in range(10) for t, lang in (("Ä b, ä c. z z z z", None), ("é é!\né é", "fr"), ("a b\x0bc d", "fr"), ("", "fr"), (None, "fr"), (".,;", "none"))]
    same(phrases.collocations(spark.createDataFrame(rows, SCHEMA)), plain([r for r in rows if r[2] != "none"]))


def test_empty(none):
    assert phrases.collocations(none).count() == 0
