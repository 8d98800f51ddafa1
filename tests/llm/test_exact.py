import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from massq.llm import exact


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 40) - 1), max_size=200))
def test_golomb_round_trip(values):
    sorted_values = np.array(sorted(values), np.uint64)
    assert exact.ungolomb(exact.golomb(sorted_values, 40)).tolist() == sorted_values.tolist()


def test_codes_are_short():
    values = np.sort(np.random.default_rng(1).choice(1 << 34, 4096, replace=False)).astype(np.uint64)
    assert len(exact.golomb(values, 34)) < 4096 * 25 / 8


def normal(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_groups(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r)
    got = exact.duplicates(docs).collect()
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for x in got:
        by_sha[x.text_sha256].append(x)
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        found = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        assert {x.keep_id for x in found} == {best[0]} and {x.group_size for x in found} == {len(members)}
        assert sorted(map(repr, (x.doc_id for x in found))) == sorted(map(repr, (r[0] for r in members)))
        assert [x.doc_id for x in found if x.kept] == [best[0]]


def test_dropping(docs, rows):
    out = exact.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert out.count() == len({normal(r[1]) for r in rows})


def test_empty(none):
    assert exact.duplicates(none).count() == 0 and exact.drop_duplicates(none).count() == 0


def test_one_row_of_a_group_that_fills_blocks(spark):
    """More rows than a block in one partition, all equal, the best one at the first place of the second block."""
    best = exact.BLOCK
    docs = spark.range(0, exact.BLOCK + 30_000, 1, 1).selectExpr(f"if(id = {best}, -1L, id + 10) AS doc_id", "'a b' AS text")
    got = exact.duplicates(docs)
    kept = got.where("kept").collect()
    assert [(x.doc_id, x.keep_id, x.group_size) for x in kept] == [(-1, -1, exact.BLOCK + 30_000)] and got.count() == exact.BLOCK + 30_000


def test_blocks_are_never_longer():
    import pandas as pd

    class Context:
        @staticmethod
        def partitionId():
            return 3

    import pyspark

    before = pyspark.TaskContext.get
    pyspark.TaskContext.get = staticmethod(lambda: Context)
    try:
        part = pd.DataFrame({"doc_id": range(50_000), "missing": False, "n": 1, "fp": range(50_000), "sha": b"x" * 32})
        sizes = [len(b.ids[0]) for b in exact._blocks(iter([part] * 7))]
    finally:
        pyspark.TaskContext.get = before
    assert sizes == [exact.BLOCK, exact.BLOCK, 350_000 - 2 * exact.BLOCK]


def test_more_suspects_than_are_sent(docs, rows, monkeypatch):
    """Beyond BROADCAST every text takes part in the grouping, with the same result."""
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(exact.duplicates(docs))
    monkeypatch.setattr(exact, "BROADCAST", 1)
    assert key(exact.duplicates(docs)) == want
