import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from massq.llm import simhash
from conftest_llm import LOWER


def plain_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=4):
    """Root (the least) of each fingerprint."""
    above = {f: f for f in fps}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in combinations(sorted(above), 2):
        if (a ^ b).bit_count() <= bits:
            x, y = sorted((root(a), root(b)))
            above[y] = x
    return {f: root(f) for f in above}


def check(got, rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots, least = plain_components(fps), {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[roots[f]] = min(r[0], least.get(roots[f], r[0]))
    want = sorted(((r[0], f"{f:016x}", least.get(roots[f])) for r, f in zip(rows, fps, strict=True)), key=repr)
    assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in got), key=repr) == want


@pytest.mark.parametrize(("segments", "crowd"), [(None, simhash.CROWD), (2, simhash.CROWD), (3, 3)])
def test_classes(docs, rows, segments, crowd):
    check(simhash.classes(docs, segments=segments, crowd=crowd).collect(), rows)


def test_same_hash_as_spark(spark):
    x = spark.sql("SELECT hex(xxhash64('a b c d')) AS h").first().h
    assert int(x, 16) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("segments", [1, 2, 3, 4])
def test_radii_leave_no_pair_out(segments):
    for bits in (2, 4) if segments > 1 else (2,):
        assert sum(r + 1 for r in simhash.radii(segments, bits)) == bits + 1
    assert [s for s, _ in simhash.cuts(segments)][0] == 0 and sum(w for _, w in simhash.cuts(segments)) == 64


def near_fingerprints(seed, families=20, size=30):
    rng, out = random.Random(seed), set()
    for _ in range(families):
        f = rng.getrandbits(64)
        for _ in range(size):
            out.add(f)
            for k in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << k
    return out


@pytest.mark.parametrize(("segments", "crowd"), [(4, 1 << 15), (3, 1 << 15), (2, 1 << 15), (4, 4), (2, 2)])
def test_links_join_what_all_pairs_join(spark, segments, crowd):
    fps = near_fingerprints(segments + crowd)
    vids = spark.createDataFrame([(simhash.signed(f),) for f in fps], "vid long").repartition(3)
    links = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.links(vids, segments=segments, crowd=crowd).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    above = {f: f for f in fps}
    for a, b in links * 8:
        above[a] = above[b] = min(above[a], above[b])
    groups, want = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[above[f]].add(f)
    for f, r in plain_components(fps).items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_a_crowd_gives_a_link_a_row():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.choice(simhash.ball(64, 2), 1500))
    a, b = simhash.joined(fps, np.ones(len(fps), bool), 4)
    assert len(a) == len(fps) - 1


def test_long_text_in_pieces():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(3 * simhash.PIECE))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_empty(none):
    assert simhash.classes(none).count() == 0
