import hashlib
import re

import corpus_pipeline
from conftest_llm import words
from pyspark.sql import functions as F
from test_mixing import filled
from test_near import all_pairs
from test_quality import plain_scores

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if name == "exact":
            texts = [re.sub("[\x20\x09-\x0d]", "", r.text) for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert 0.5 * sizes[0] < sizes[1] < sizes[0] and sizes[3] <= sizes[2] <= sizes[1] and sizes[4] == sizes[5] > 0


def test_run_keeps_bytes(spark):
    out = corpus_pipeline.run(spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for x in out.where(F.col("n_tokens") > 0).limit(50).collect():
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest() and len(x.ids) == x.n_tokens


def _labels(spark, tmp_path):
    rows = [(i, i % 3 // 2 if i % 7 else None, 0) for i in range(120)] + [(None, 1, 0), (4, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), [(r[0], r[1]) for r in rows]


def _plain(name, rows, labels):
    """What a stage keeps of (doc_id, text, lang, source), worked out row by row on the driver."""
    if name == "quality":
        scores = plain_scores([(r[0], r[1]) for r in rows], labels)
        return [r for r, s in zip(rows, scores, strict=True) if s >= 0.7]
    if name == "exact":
        best = {}
        for r in rows:
            key = re.sub("[\x20\x09-\x0d]", "", r[1] or "")
            rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
            if key not in best or rank < best[key][0]:
                best[key] = (rank, r)
        return [r for _, r in best.values()]
    shown = [r for r in rows if words(r[1])]
    of, best = all_pairs([r[1] for r in shown], 80), {}
    for r, k in zip(shown, of, strict=True):
        best.setdefault(k, []).append(r)
    return [r for r in rows if not words(r[1])] + [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in best.values()]


def test_stages_against_plain_versions(spark, docs, tmp_path):
    """Nulls, ties, repeated ids and rows, a hot source, a very long text, columns that clash with the operators' own names."""
    sf, labels = _labels(spark, tmp_path)
    table = docs.selectExpr("doc_id", "text", "lang", "source", "'a' AS vid", "1 AS row", "2 AS _n_id", "3 AS _x_id", "4 AS _mix_key", "5 AS _f_", "6 AS kept")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r)[:4] for r in table.collect()]
        out = stage(spark, table, sf)
        if name == "mix":
            assert out.columns == table.columns
            taken = {}
            for r in out.collect():
                taken[tuple(r)[:4]] = taken.get(tuple(r)[:4], 0) + 1
            assert set(taken) <= set(rows) and max(taken.values()) <= 3
            sizes, got = {}, {}
            for r in rows:
                sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
            for r, n in taken.items():
                got[r[3]] = got.get(r[3], 0) + n * len(words(r[1]))
            want, most = filled(sizes, (5, 2, 1)), max(len(words(r[1])) for r in rows)
            assert all(abs(got.get(s, 0) - want[s]) <= most for s in sizes)
        elif name == "tokens":
            for x in out.collect():
                assert x.decoded_sha256 in {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows if r[0] == x.doc_id} and len(x.ids) == x.n_tokens
            assert out.count() == len(rows)
            break
        else:
            assert out.columns == table.columns
            key = lambda r: (repr(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) if name != "near" else repr(r[0])  # noqa: B023, E731
            assert sorted(map(key, out.collect())) == sorted(map(key, _plain(name, rows, labels)))
        if name != "quality":  # so the stages after it see every row
            out.write.parquet(str(tmp_path / str(k)))
            table = spark.read.parquet(str(tmp_path / str(k)))


def test_stages_on_no_rows(spark, none, tmp_path):
    sf, _ = _labels(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0 and (name == "tokens" or out.columns == none.columns)
