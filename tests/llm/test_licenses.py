import re

from massq.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_phrases(docs, rows):
    from conftest_llm import LOWER

    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    by_id = {x.doc_id: x for x in got}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        want = sorted((i, t.label) for t in licenses.BASE for i in range(len(w)) if w[i : i + len(t.words)] == t.words)
        x = by_id[r[0]]
        assert x.n_words == len(w) and sorted((s.start, s.label) for s in x.spans if s.base) == want


def test_passages_with_gaps(spark):
    text = next(t for t in licenses.OWN if t.label == "mit-text").text.split()
    damaged = text[:20] + ["of"] + text[21:30] + ["more", "words"] + text[30:]
    docs = spark.createDataFrame([(1, "before " + " ".join(damaged) + " after"), (2, " ".join(reversed(text))), (3, None)], "doc_id long, text string")
    got = {x.doc_id: [s.label for s in x.spans] for x in licenses.scan(docs).collect()}
    assert "mit-text" in got[1] and "mit-text" not in got[2] and got[3] == []


def test_native(docs, none):
    assert "Python" not in licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert licenses.scan(none).count() == 0


def plain_spans(text, slack=3):
    """All spans by the method's definition: votes of a text's pairs by diagonal, neighbouring diagonals merged, then the share of pairs that voted."""
    from conftest_llm import LOWER

    w, out = WORD.findall((text or "").translate(LOWER)), []
    for k, t in enumerate(licenses.BASE + licenses.OWN):
        votes = {}
        for p in range(len(w) - 1):
            for at, a, b in t.pairs:
                if (w[p], w[p + 1]) == (a, b):
                    votes.setdefault(p - at, []).append((p, at))
        bands, last = [], None
        for d in sorted(votes):
            if last is None or t.exact or d - last > slack:
                bands.append((d, []))
            bands[-1][1].extend(votes[d])
            last = d
        for d, found in bands:
            share = len({at for _, at in found}) / len(t.pairs)
            if share == 1 if t.exact else share >= t.share:
                out.append((d if t.exact else min(p for p, _ in found), k, max(p for p, _ in found) + 1, round(share, 9)))
    return sorted(out)


def test_spans_against_the_definition(spark):
    import random

    rng = random.Random(3)
    passages = [t.text for t in licenses.BASE + licenses.OWN]
    texts = [None, "", "!!!", "license", "MIT LICENSE mit license mit", "apache license version 2 0 apache license", "gnu general public license version 3 gnu general public license version 2"]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(passages).split()
            for x in own:  # words are lost, changed and added
                words += rng.choice([[x]] * 16 + [[], ["changed"], [x, "added"], [x.upper()]])
            words += rng.choices(["the", "of", "license", "software", "filler"], k=rng.randint(0, 12))
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    texts += [texts[-1]] * 2 + [" ".join(passages * 40)]  # repeated rows, and a very long text in which every passage repeats
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, template string, n int, p int")).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        assert [(s.start, s.template, s.end, round(s.share, 9)) for s in got[k].spans] == plain_spans(t)
    assert sum(len(r.spans) for r in got.values()) > 300
