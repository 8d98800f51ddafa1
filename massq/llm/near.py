"""Near-duplicate detection by an LSH forest.

A document is the set of its five-word shingles. Texts with equal sets collapse to
one vertex first, so copies cost nothing further on. Each vertex has a pool of
``POOL`` minimum hashes and stands in ``TREES`` sorted orders, each of another
sequence of the pool. Spark range-partitions every order, so a crowded region is
split at deeper positions by itself. In a sorted stretch, neighbours that share a
prefix are candidates: ``SHALLOW`` values suffice where few share them, and where more
than ``REGION`` do, the region is divided at one value more, again and again. In a region
each vertex proposes its best partners by estimated similarity, not all pairs.
Candidates are confirmed on full sets, and confirmed links joined to components.

That first round leaves few components. The second one makes it whole: vertices that
share ``SHALLOW`` values in an order meet once more, however many they are, and each pair
of them that is likely enough and whose ends lie in different components is confirmed as
well. A spot with many vertices is dealt out in pairs of blocks, so no task holds it
whole and none is divided. Pairs inside a component need no look, so a group of near
copies that the first round joined costs nothing here: the blocks of a spot's largest
component meet those of the others only, never each other.

Edge cases: no words or a null text: an empty set, linked with nothing. Fewer than five
words: one shingle, the whole sequence. Rows that repeat an id and text are linked
with each other and with what either is linked. Only the id and text are read. A very long text is
one set like any other, hashed in pieces. An empty table gives an empty result.

Similarity is a percentage: op5_near's classes have 85, ``drop_near_duplicates`` has 80
unless the caller names another.

What can be missed: a pair at similarity 0.85 shares no prefix of 3 values in any of
16 orders with probability 3e-7, at 0.8 with 1e-5, in a crowded region too. The
estimate's cut-off lies 4 deviations below the similarity asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from massq.llm.common import cut, sent, small_batches
from massq.operators.graph import components

SHINGLE = 5
POOL, TREES, DEPTH, SHALLOW = 128, 16, 16, 3
#: Of the first round: vertices of a region that are compared with each other, and partners that each proposes there.
REGION, PARTNERS = 256, 8
#: Rows of the first round that a task holds at once. What parts at their ends is left to the second round.
STRETCH = 1 << 15
#: Vertices in a block of the second round, and rows of its comparison that are held at once.
BLOCK, ROWS = 256, 32
#: A vertex with more than one row in so many of all is hot; there are fewer of those than this.
HOT = 1000
#: Percentage of shared shingles from which documents are near duplicates: in classes, and where near duplicates are dropped.
PERCENT, DROP_PERCENT = 85, 80

_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 32, POOL, dtype=np.uint64).astype(np.uint32)
_TIMES = _RNG.integers(0, 1 << 31, POOL, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_WIDTH = POOL // TREES
#: Positions of the pool that each order looks at: its own eighth first, so no two orders share them, then others'.
_ORDERS = np.array([[(t * _WIDTH + i) % POOL if i < _WIDTH else ((t + 5) * _WIDTH + i) % POOL for i in range(DEPTH)] for t in range(TREES)])


def likely(percent: int) -> float:
    """Estimated similarity from which a pair is a candidate."""
    same = (1 + 15 * percent / 100) / 16  # chance that 4 bits of two minima are equal
    return percent / 100 - 4 * 16 / 15 * math.sqrt(same * (1 - same) / POOL)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    total = np.full(n, np.uint64(min(len(words), SHINGLE)), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        total += mixed(hashes[k : k + n] * _ODD[k])
    return np.unique(mixed(total))


def minima(found: np.ndarray) -> np.ndarray:
    """The pool's minimum hashes of a set, in pieces that stay in the cache."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(POOL, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, ((x[None, at : at + 512] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    return least


def vertex(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _fixed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ns, keys, pools = batch.column(0), [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            ns.append(len(found))
            keys.append(vertex(found) if len(found) else None)
            pools.append(minima(found).astype("<u4").tobytes() if len(found) else None)
        yield pa.record_batch([ids, pa.array(ns, pa.int64()), _fixed(keys), _fixed(pools)], ["doc_id", "n", "vid", "pool"])


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each order: the order, its values (16 bits each), the vertex, its size and its sketch (4 bits of each minimum)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        pools = np.frombuffer(b"".join(batch.column("pool").to_pylist()), "<u4").reshape(n, POOL)
        low = (pools & 15).astype(np.uint8)
        sketch = (low[:, ::2] << 4) | low[:, 1::2]
        sketches = [row.tobytes() for row in sketch]
        vids, sizes = batch.column("vid"), batch.column("n")
        for t in range(TREES):
            values = ((pools[:, _ORDERS[t]] >> np.uint32(8)) & np.uint32(0xFFFF)).astype(">u2")
            yield pa.record_batch([pa.array(np.full(n, t, np.int32)), _fixed([row.tobytes() for row in values]), vids, sizes, _fixed(sketches)], ["tree", "prefix", "vid", "n", "sketch"])


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vertex: its component and size, its sketch, and a number for the first SHALLOW values in each order."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        pools = np.frombuffer(b"".join(batch.column("pool").to_pylist()), "<u4").reshape(n, POOL)
        low = (pools & 15).astype(np.uint8)
        values = ((pools[:, _ORDERS[:, :SHALLOW]] >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.uint64)
        at = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (n, TREES))
        for k in range(SHALLOW):
            at = (at << np.uint64(16)) | values[:, :, k]
        spots = mixed(at).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES + 1, TREES, dtype=np.int32)), pa.array(spots.ravel()))
        yield pa.record_batch([batch.column("vid"), batch.column("comp"), batch.column("n"), _fixed([row.tobytes() for row in (low[:, ::2] << 4) | low[:, 1::2]]), lists], ["vid", "comp", "n", "sketch", "spots"])


def regions(shared: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of two rows or more, given how many values each row shares with the one before.

    A stretch that shares ``SHALLOW`` values and has at most REGION rows is a region; a longer one
    is divided where it shares one value less than the next depth asks. What is still
    too long when all values are equal is dealt out in overlapping windows.
    """
    todo = [(0, len(shared), SHALLOW - 1)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        if depth >= SHALLOW and hi - lo <= REGION:
            yield lo, hi
        elif depth == DEPTH:
            for at in range(lo, hi - 1, REGION // 2):
                yield at, min(hi, at + REGION)
                if at + REGION >= hi:
                    break
        else:
            cuts = lo + 1 + np.flatnonzero(shared[lo + 1 : hi] < depth + 1)
            ends = np.concatenate([[lo], cuts, [hi]])
            for k in np.flatnonzero(np.diff(ends) > 1):
                todo.append((int(ends[k]), int(ends[k + 1]), depth + 1))


def proposed(sketch: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a region: each row's best partners among those that may be similar enough."""
    n = len(sketch)
    same = np.concatenate([agreeing(sketch[lo : lo + ROWS], sketch) for lo in range(0, n, ROWS)])
    estimate = (16 * same / POOL - 1) / 15
    small, large = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
    estimate[(100 * small < percent * large) | (estimate < likely(percent))] = -1
    np.fill_diagonal(estimate, -1)
    if n > PARTNERS + 1:
        best = np.argpartition(-estimate, PARTNERS, axis=1)[:, :PARTNERS]
        a, b = np.repeat(np.arange(n), PARTNERS), best.ravel()
    else:
        a, b = np.triu_indices(n, 1)
    good = estimate[a, b] >= 0
    return a[good], b[good]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= STRETCH:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _propose(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _stretches(batches):
        n = rows.num_rows
        flat = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(n, -1)  # noqa: B023, E731
        trees, prefix, sketch, vids, sizes = rows.column("tree").to_numpy(), flat("prefix", ">u2"), flat("sketch", np.uint8), rows.column("vid").to_pylist(), rows.column("n").to_numpy()
        differs = prefix[1:] != prefix[:-1]
        shared = np.concatenate([[0], np.where(trees[1:] != trees[:-1], 0, np.where(differs.any(axis=1), differs.argmax(axis=1), DEPTH))])
        found: set[tuple[bytes, bytes]] = set()
        for lo, hi in regions(shared):
            a, b = proposed(sketch[lo:hi], sizes[lo:hi], percent)
            found.update(((vids[lo + i], vids[lo + j]) if vids[lo + i] < vids[lo + j] else (vids[lo + j], vids[lo + i])) for i, j in zip(a.tolist(), b.tolist(), strict=True))
        yield pa.record_batch([_fixed([x for x, _ in found]), _fixed([y for _, y in found])], ["a", "b"])


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the POOL minima of each sketch of ``a`` and each of ``b`` agree in their 4 bits: a matrix."""
    x = a.view(np.uint64)[:, None, :] ^ b.view(np.uint64)[None, :, :]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= np.uint64(0x1111111111111111)  # a bit for each group of four that differs
    return POOL - np.bitwise_count(x).sum(axis=2, dtype=np.int32)


def crossing(comp: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, spots: np.ndarray, spot: int, block: np.ndarray, apart: bool, percent: int) -> Iterator[tuple[int, int]]:
    """All pairs of a spot's rows that may be similar enough and lie in different components, at the first spot that both share; of two blocks, if ``apart``."""
    least, places = likely(percent), np.arange(len(comp))
    mine = block == block.min()
    ones, others = (places[mine], places[~mine]) if apart else (places, places)
    for lo in range(0, len(ones), ROWS):
        own = ones[lo : lo + ROWS, None]
        rest = others if apart else places[lo + 1 :]
        good = (comp[own] != comp[rest]) & (apart | (rest > own))
        small, large = np.minimum(sizes[own], sizes[rest]), np.maximum(sizes[own], sizes[rest])
        good &= 100 * small >= percent * large
        if not good.any():
            continue
        good &= (16 * agreeing(sketch[own[:, 0]], sketch[rest]) / POOL - 1) / 15 >= least
        i, j = np.nonzero(good)
        i, j = own[i, 0], rest[j]
        first = (spots[i] == spots[j]).argmax(axis=1)
        met = spots[i, first] == spot
        yield from zip(i[met].tolist(), j[met].tolist(), strict=True)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of a partition that is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        ends = [0, *cuts.tolist(), batch.num_rows]
        for k in range(len(ends) - 1):
            held.append(batch.slice(ends[k], ends[k + 1] - ends[k]))
            if k + 2 < len(ends):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _cross(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each pair of blocks that have a partner in another component; given their sets, confirmed links between components instead."""
    for rows in _groups(batches, ["spot", "lo", "hi"]):
        n, vids, (spot, lo, hi) = rows.num_rows, rows.column("vid").to_pylist(), (rows.column(k)[0].as_py() for k in ("spot", "lo", "hi"))
        block = rows.column("block").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
        spots = rows.column("spots").combine_chunks().flatten().to_numpy().reshape(n, TREES)
        comp = rows.column("comp").to_numpy()
        pairs = crossing(comp, rows.column("n").to_numpy(), sketch, spots, spot, block, lo != hi, percent)
        if "members" not in rows.column_names:
            found = sorted({k for pair in pairs for k in pair})
            yield pa.record_batch([*(pa.array([k] * len(found), pa.int64()) for k in (spot, lo, hi)), pa.array(block[found], pa.int64()), _fixed([vids[k] for k in found])], ["spot", "lo", "hi", "block", "vid"])
            continue
        sets, above, links = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()], {}, []
        for i, j in pairs:
            x, y = int(comp[i]), int(comp[j])
            while x in above:
                x = above[x]
            while y in above:
                y = above[y]
            if x != y and alike(sets[i], sets[j], percent):
                above[x] = y
                links.append((vids[i], vids[j]))
        yield pa.record_batch([_fixed([x for x, _ in links]), _fixed([y for _, y in links])], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column("text")]
        yield pa.record_batch([_fixed([vertex(f) for f in found]), _fixed([f.tobytes() for f in found])], ["vid", "members"])


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(p) > len(q):
        p, q = q, p
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _confirm(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("one"), batch.column("other"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _members(slim: DataFrame, vertices: DataFrame, vids: DataFrame) -> DataFrame:
    """(vid, members): the full sets of ``vids``, read from the texts again."""
    wanted = cut(vids.select("vid").distinct().join(vertices.select("vid", "rep"), "vid").select("vid", F.col("rep").alias("doc_id")))
    texts = slim.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    if not wanted.where("doc_id is null").isEmpty():  # vertices all of whose rows have no id
        texts = texts.union(slim.where("doc_id is null"))
    return cut(texts.mapInArrow(_sets, "vid binary, members binary").join(wanted.select("vid"), "vid", "left_semi").groupBy("vid").agg(F.first("members").alias("members")))


def _confirmed(slim: DataFrame, vertices: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose full sets are similar enough."""
    members = _members(slim, vertices, pairs.select(F.explode(F.array("a", "b")).alias("vid")))
    one = members.select(F.col("vid").alias("a"), F.col("members").alias("one"))
    other = members.select(F.col("vid").alias("b"), F.col("members").alias("other"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(partial(_confirm, percent), "a binary, b binary")


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (spot, m, vid, comp) once for each pair of blocks (lo, hi) that its own block belongs to.

    m rows share the spot. ``big`` of them, of the component ``most``, need not meet each
    other: their blocks are the first ones and pair with the rest's alone. Where ``most`` is
    null, all blocks pair with all.
    """
    blocks = lambda c: F.ceil(c / BLOCK)
    own, first = F.coalesce(F.col("comp") == F.col("most"), F.lit(False)), blocks(F.coalesce("big", F.lit(0)))
    rest = blocks(F.col("m") - F.coalesce("big", F.lit(0)))
    block = F.when(own, F.pmod(F.xxhash64("vid"), first)).otherwise(first + F.pmod(F.xxhash64("vid"), rest))
    met = rows.withColumns({"block": block, "other": F.explode(F.sequence(F.when(own, first).otherwise(F.lit(0)), first + rest - 1))})
    return met.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("m", "most", "big", "other")


def _crowds(each: DataFrame, several: DataFrame) -> DataFrame:
    """``several`` (spot, m) with the largest component of each spot that takes more than one block."""
    crowded = several.where(F.col("m") > BLOCK)
    none = several.withColumns({"most": F.lit(None).cast("long"), "big": F.lit(None).cast("long")})
    if crowded.isEmpty():
        return none
    sizes = each.join(crowded.select("spot"), "spot").groupBy("spot", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("spot").agg(F.max(F.struct("n", "comp")).alias("c"))
    return cut(several.join(most, "spot", "left").select("spot", "m", F.col("c.comp").alias("most"), F.col("c.n").alias("big")))


def _crossed(slim: DataFrame, vertices: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of ``roots``: of all likely pairs that share SHALLOW values in an order, as many as join what is similar.

    Vertices of a spot meet twice, first by their sketches alone, then those that have a
    partner by their sets. Pairs stay inside a task, so no table grows with their number.
    """
    of = vertices.join(roots.withColumnRenamed("node", "vid"), "vid", "left").select("vid", F.xxhash64(F.coalesce("root", "vid")).alias("comp"), "n", "pool")
    marks = cut(of.mapInArrow(_spots, "vid binary, comp long, n long, sketch binary, spots array<long>"))
    each = marks.select("vid", "comp", F.explode("spots").alias("spot"))
    several = cut(each.groupBy("spot").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high").select("spot", "m"))
    keys, columns = ["spot", "lo", "hi"], ["block", "vid", "comp", "n", "sketch", "spots"]
    dealt = lambda rows, *more: rows.select(*keys, *columns, *more).repartition(*keys).sortWithinPartitions(*keys)
    met = in_blocks(each.join(_crowds(each, several), "spot")).drop("comp").join(marks, "vid")
    found = cut(dealt(met).mapInArrow(partial(_cross, percent), "spot long, lo long, hi long, block long, vid binary"))
    again = found.join(marks, "vid").join(_members(slim, vertices, found), "vid")
    return dealt(again, "members").mapInArrow(partial(_cross, percent), "a binary, b binary")


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, vid), vertices (vid, rep), and (node, root) of those vertices that are linked."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(slim.mapInArrow(_read, "doc_id long, n long, vid binary, pool binary"))
    vertices = rows.where("vid is not null").groupBy("vid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("pool").alias("pool"), F.count(F.lit(1)).alias("copies"))
    vertices = cut(vertices)
    forest = vertices.select("vid", "n", "pool").mapInArrow(_plant, "tree int, prefix binary, vid binary, n long, sketch binary")
    ordered = forest.repartitionByRange("tree", "prefix", "vid").sortWithinPartitions("tree", "prefix", "vid")
    pairs = cut(ordered.mapInArrow(partial(_propose, percent), "a binary, b binary").distinct())
    roots = cut(components(_confirmed(slim, vertices, pairs, percent)))
    crossed = cut(_crossed(slim, vertices, roots, percent))
    if not crossed.isEmpty():
        roots = components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(crossed))
    return rows.select("doc_id", "n", "vid"), vertices.select("vid", "rep", "copies"), roots


def _of_rows(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` (doc_id, n, vid) left-joined with ``of`` (vid, copies, ...), which is written already.

    Hot vertices are fewer than HOT, so what ``of`` says of them is broadcast, and rows without
    words have no partner: neither meets in one task.
    """
    hot = of.where(F.col("copies") * HOT > rows.count())
    more = [(f.name, f.dataType) for f in of.schema.fields if f.name not in ("vid", "copies")]
    some, cold = rows.where("vid is not null"), of.drop("copies")
    least = some.join(F.broadcast(hot.select("vid")), "vid", "left_anti").join(cold, "vid", "left")
    return least.unionByName(some.join(F.broadcast(hot.drop("copies")), "vid")).unionByName(rows.where("vid is null").withColumns({n: F.lit(None).cast(t) for n, t in more}))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows, vertices, roots = _linked(docs, id_col, text_col, percent)
    joined = vertices.join(roots.withColumnRenamed("node", "vid"), "vid")
    least = joined.groupBy("root").agg(F.min("rep").alias("component"))
    of = cut(vertices.join(joined.select("vid", "root"), "vid", "left").join(least, "root", "left").select("vid", "copies", F.coalesce("component", "rep").alias("component")))
    out = _of_rows(rows, of).withColumn("component", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def _with_vid(at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(text.as_py()) for text in batch.column(at)]
        vids = _fixed([vertex(f) if len(f) else None for f in found])
        yield pa.record_batch([*batch.columns[:at], *batch.columns[at + 1 :], vids], [*batch.schema.names[:at], *batch.schema.names[at + 1 :], "_n_vid"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = DROP_PERCENT) -> DataFrame:
    """``docs`` with one row of each class, its own columns only.

    The row with the least id stays (a null one last), then that of the least vertex. Ids of
    which all rows go are named by the id alone. Null ids, and ids that also have a row that
    stays, are told apart by their texts. Rows without words are in no class and stay.
    """
    rows, vertices, roots = _linked(docs, id_col, text_col, percent)
    of = cut(vertices.join(roots.withColumnRenamed("node", "vid"), "vid", "left").select("vid", "rep", "copies", F.coalesce("root", "vid").alias("root")))
    first = of.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "vid", "copies")).alias("first"))
    kept = cut(first.select("first.vid", "first.copies", F.col("first.rep").alias("rep"), F.lit(True).alias("first")))
    found = cut(_of_rows(rows, kept).select("doc_id", "vid", (F.col("vid").isNull() | (F.col("first").isNotNull() & F.col("doc_id").eqNullSafe(F.col("rep")))).alias("stays")))
    each = found.groupBy("doc_id", "vid").agg(F.first("stays").alias("stays"), F.count("vid").alias("m"))
    ids = each.groupBy("doc_id").agg(F.bool_or("stays").alias("some"), F.bool_and("stays").alias("every"), F.bool_or(F.col("stays") & (F.col("m") > 1)).alias("twice"))
    gone = cut(ids.where("not some and doc_id is not null").select(F.col("doc_id").alias("_n_id")))
    mixed = cut(ids.where("twice or not every and (some or doc_id is null)").select("doc_id"))
    out = docs.withColumn("_n_id", F.col(id_col).cast("long")).join(sent(gone), "_n_id", "left_anti")
    if not mixed.isEmpty():
        key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_n_key")
        these = cut(mixed.select(key(F.col("doc_id"))))
        stay = cut(found.where("stays and vid is not null").select(key(F.col("doc_id")), F.col("vid").alias("_n_vid")).join(these, "_n_key", "left_semi").distinct())
        keyed = out.withColumn("_n_key", key(F.col("_n_id")))
        mine = keyed.join(these, "_n_key", "left_semi").withColumn("_n_text", F.col(text_col).cast("string"))
        at, fields = len(mine.columns) - 1, [f for f in mine.schema.fields if f.name != "_n_text"]
        mine = cut(mine.mapInArrow(partial(_with_vid, at), StructType([*fields, StructField("_n_vid", BinaryType())])))
        one = mine.join(stay, ["_n_key", "_n_vid"], "left_semi").dropDuplicates(["_n_key", "_n_vid"])
        out = keyed.join(these, "_n_key", "left_anti").unionByName(mine.where("_n_vid is null").unionByName(one).drop("_n_vid"))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS k FROM w),
e AS (SELECT doc_id, len(k) AS n, md5(unnest(k)) AS h FROM s),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS common FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * common >= 85 * (na + nb - common)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(v, t) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.v, u.b FROM r JOIN u ON r.t = u.a),
c AS (SELECT v, min(t) AS component_id FROM r GROUP BY v)
SELECT s.doc_id, len(k)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON v = s.doc_id
"""
