import numpy as np
from conftest_llm import remainder, words
from pyspark.sql import functions as F

from massq.llm import quality


def test_scores_match_the_densities(spark, docs):
    rows = quality.statistics(docs.select("doc_id", "text"))
    rows = rows.withColumns({"label": (F.col("doc_id") % 2).cast("int"), "weight": F.lit(1)}).where("doc_id is not null")
    model = quality.fit(rows)
    got = rows.select("_f_", model.score(F.col("_f_")).alias("s")).collect()
    x = np.array([r["_f_"] for r in got])
    sides = []
    for k in (0, 1):
        z = (x - model.means[k]) @ model.factors[k].T
        sides.append(model.priors[k] - 0.5 * model.logdets[k] - 0.5 * (z**2).sum(axis=1))
    want = 1 / (1 + np.exp(-np.clip((sides[1] - sides[0]) / quality.TEMPERATURE, -500, 500)))
    assert np.allclose([r["s"] for r in got], want, atol=1e-9)


def plain_statistics(text):
    """The bounded statistics, from the text."""
    import unicodedata

    from massq.llm.rules import STOP_WORDS

    text = text or ""
    w, of = words(text), lambda test: sum(1 for c in text if test(c))
    share = lambda a, b: a / max(b, 1.0)
    squash = lambda x, at: x / (x + at)
    n, chars = len(w), len(text)
    category = lambda k: of(lambda c: unicodedata.category(c) == k)
    return [
        squash(share(category("Lu"), chars), 0.1), squash(share(text.count("!"), n), 0.2), squash(share(of(lambda c: c in "#*$%&|<>@~^_=+{}[]"), n), 0.2),
        squash(share(category("Nd"), chars), 0.05), squash(share(sum(x.lower() in STOP_WORDS for x in w), n), 0.2), share(len(set(w)), n),
        squash(share(sum(a == b for a, b in zip(w, w[1:], strict=False)), n), 0.1), squash(share(of(lambda c: c in ".,;:?"), n), 0.15),
        squash(share(text.count("\n"), n), 0.05), squash(share(chars, n), 6.0), squash(np.log1p(n), 5.0),
    ]


def plain_scores(rows, labels):
    """Scores of (doc_id, text) rows after a fit on (doc_id, quality) rows outside the fold: densities by their definition."""
    of = {}
    for doc_id, label in labels:
        if label in (0, 1) and remainder(doc_id, 4) != 2:
            of.setdefault(doc_id, []).append(label)
    x = np.array([plain_statistics(t) for _, t in rows]).reshape(-1, 11)
    seen = [(x[i], k) for i, (d, _) in enumerate(rows) for k in of.get(d, ()) if d is not None]
    by = [np.array([v for v, k in seen if k == c]).reshape(-1, 11) for c in (0, 1)]
    n = np.array([len(b) for b in by])
    prior = np.log((n + 1) / (n.sum() + 2))
    if n.min() < 2:
        margin = np.full(len(x), prior[1] - prior[0]) / quality.TEMPERATURE
        return 1 / (1 + np.exp(-margin))
    cov = [np.cov(b.T, bias=True) for b in by]
    unit = np.sqrt(np.maximum(sum(m * np.diag(c) for m, c in zip(n / n.sum(), cov, strict=True)), 1e-6))
    sides = []
    for k in (0, 1):
        shrunk = ((1 - quality.SHRINKAGE) * cov[k] / np.outer(unit, unit) + quality.SHRINKAGE * np.eye(11)) * np.outer(unit, unit)
        z = x - by[k].mean(axis=0)
        sides.append(prior[k] - 0.5 * (np.linalg.slogdet(shrunk)[1] - 2 * np.log(unit).sum()) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(shrunk), z))
    return 1 / (1 + np.exp(-np.clip((sides[1] - sides[0]) / quality.TEMPERATURE, -500, 500)))


def test_fit_against_the_definition(spark, docs, rows):
    labels = [(i, None if i % 9 == 0 else i % 2) for i in range(120)] + [(5, 1), (5, 1), (None, 0)]
    frame = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    pairs = [(r[0], r[1]) for r in rows]
    want = sorted(zip(map(repr, (r[0] for r in rows)), np.round(plain_scores(pairs, labels), 6).tolist(), strict=True))
    got = sorted((repr(x.doc_id), round(x.score, 6)) for x in quality.classify(docs, frame).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-6)
    kept = sorted(repr(d) for d, s in zip((r[0] for r in rows), plain_scores(pairs, labels), strict=True) if s >= quality.CUT)
    assert sorted(repr(x.doc_id) for x in quality.keep_good(docs, frame).collect()) == kept


def test_sample_is_bounded_and_weighs_repeats(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").union(spark.createDataFrame([(3, 1)] * 5, "doc_id long, quality int"))
    some = quality.known_labels(labels, "doc_id", "quality", (4, 2), 1000)
    assert 800 < some.count() < 1200
    every = quality.known_labels(labels, "doc_id", "quality", (4, 2))
    assert every.where("_f_id = 3").select("weight").collect()[0][0] == 6


def test_names_that_clash_and_no_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    clash = docs.selectExpr("doc_id", "text", "1 AS _f_", "'h' AS _f_held", "2 AS row", "3 AS label", "4 AS weight", "5 AS _f_id")
    assert sorted(map(repr, quality.keep_good(clash, labels).select("doc_id", "text").collect())) == sorted(map(repr, quality.keep_good(docs, labels).select("doc_id", "text").collect()))
    assert quality.keep_good(clash, labels).columns == clash.columns
    assert quality.keep_good(none, labels).count() == 0 and quality.keep_good(none, labels.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, all_of = got.where("predicted = quality").count(), got.count()
    assert right / all_of > 0.95


def test_every_row_has_a_score(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, None if i % 9 == 0 else i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) and x.held_out == (remainder(x.doc_id, 4) == 2)
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == len(rows)
    assert quality.keep_good(docs, labels).columns == docs.columns
