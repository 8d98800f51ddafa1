import math
import re

import numpy as np

from massq.llm import langid


def plain_bits(counts, raw):
    """Code length of one text by the definition: longest context that has seen the byte, an escape for each longer one."""
    total, padded = 0.0, [0] * langid.ORDER + list(raw)
    for i in range(langid.ORDER, len(padded)):
        for order in range(langid.ORDER, -1, -1):
            context = tuple(padded[i - order : i])
            seen = counts[order].get(context)
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if padded[i] in seen:
                total -= math.log2(seen[padded[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths():
    texts = {"a": ["the thing and the other", "sharing"], "b": ["der ding und", "schön"]}
    tables, plain = [], []
    for lang in texts:
        grams = np.concatenate([langid.grams(langid._bytes(t), langid.ORDER) for t in texts[lang]])
        tables.append(tuple(np.unique(grams, return_counts=True)))
        counts = [{} for _ in range(langid.ORDER + 1)]
        for t in texts[lang]:
            padded = [0] * langid.ORDER + list(langid._bytes(t))
            for i in range(langid.ORDER, len(padded)):
                for order in range(langid.ORDER + 1):
                    seen = counts[order].setdefault(tuple(padded[i - order : i]), {})
                    seen[padded[i]] = seen.get(padded[i], 0) + 1
        plain.append(counts)
    model = langid.Model(list(texts), [(k.astype(np.uint32), n.astype(float)) for k, n in tables])
    for t in ["the ding", "xyz", "schöne other Ω", "a"]:
        raw = langid._bytes(t)
        padded = np.concatenate([np.zeros(langid.ORDER, np.uint8), raw])
        zeros = [plain_bits(c, [0] * langid.ORDER) for c in plain]
        got = model.total(padded, np.array([0]))[0]
        want = [plain_bits(c, [0] * langid.ORDER + list(raw)) for c in plain]
        assert np.allclose(got, want, rtol=1e-4), (got, want, zeros)


def test_languages(docs, rows, none):
    got = langid.identify(docs).collect()
    by_id = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    right = n = 0
    for x in got:
        r = by_id[x.doc_id]
        if not re.search(r"[^\W\d_]", r[1] or ""):
            assert x.lang_pred == "und" and x.score == 0
        elif r[2] and len(r[1]) > 40 and x.held_out:
            n += 1
            right += x.lang_pred == r[2]
        assert 0 <= x.score <= 1
    assert right / n > 0.9
    assert langid.identify(none).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in langid.identify(docs).collect()} == {"und"}


def test_many_languages_get_a_smaller_sample(docs, monkeypatch):
    whole = langid.learn(docs)
    cells = len(whole.lengths) * len(whole.langs)
    monkeypatch.setattr(langid, "MOST_CELLS", cells // 2)
    less = langid.learn(docs, sample=64)
    assert less.langs and len(less.lengths) * len(less.langs) <= cells // 2
