"""Near-duplicate detection by SimHash and multi-index hashing.

A document's 64-bit fingerprint has a bit set where over half of its shingles' hashes
have it. Documents link where ``BITS`` bits or fewer differ. Rows of equal fingerprint
collapse to one vertex first, so copies cost nothing further on.

Fingerprints are cut into segments. If two differ in at most ``BITS`` bits, then in one
of the segments they differ in no more than that segment's radius (``radii``). A table
holds every fingerprint under each of its segments' values; a fingerprint also visits
the values in the Hamming ball of that radius around its own, the smaller ones only,
so that each pair meets once in a segment. Whole distances are checked where they meet, in a task that
holds one value's visitors, and what leaves it are links that join them, one less
than there are vertices, not all pairs. Segments get longer as fingerprints get more, so
a value has a few visitors on average.

A value with over ``CROWD`` visitors isn't compared pair by pair. Fingerprints at distance 4
or less are exactly those whose balls of radius 2 overlap, and all whose balls hold the same
point are linked with each other. So each visitor of a crowd lists its ball's points
(``BALL`` of them), and neighbours in the sorted list of a point's visitors are linked: whole, without pairs,
at a cost per fingerprint, and a point has at most as many visitors as a ball has points.

Edge cases: a null or empty text, or one of white space alone, has fingerprint zero and links
like any other; fewer words than a shingle: the whole sequence is one; rows that repeat an id are
linked by their own fingerprints; a null id is passed over when the smallest is sought, and has a null component only if no linked row
has an id; very long texts are hashed in pieces; an empty table gives an empty result. Only the id and text
columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massq.llm.common import cut, small_batches
from massq.llm.near import _groups, _of_rows
from massq.operators.graph import components

SHINGLE, SEED = 4, 42
#: Fingerprints link at so many differing bits or fewer.
BITS = 4
#: Visitors that a value has on average, at most, before segments get longer.
VISITORS = 64
#: Visitors of one value that are compared with each other; beyond, balls are.
CROWD = 1 << 15
#: Rows of a comparison that are held at once.
BLOCK = 1 << 11
#: Shingles that are hashed at once.
PIECE = 1 << 13

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text's word shingles, repeats included."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts, stops = np.concatenate([[0], ends[: n - 1]]).tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        each = [line[a:b] for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(SEED)), ">u8", len(each))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def _read(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [signed(fingerprint(t.as_py(), shingle)) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "vid"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, vid): the fingerprint of each row as a signed long."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(partial(_read, shingle), "doc_id long, vid long")


def radii(segments: int, bits: int = BITS) -> list[int]:
    """Radius of each segment's ball: were all exceeded, more than ``bits`` bits would differ."""
    least, more = divmod(bits - segments + 1, segments)
    return [least + 1] * more + [least] * (segments - more)


def segments_for(n: int) -> int:
    """As many segments, 4 at most, as leave each value some VISITORS of n fingerprints or fewer."""
    return next((m for m in (4, 3) if n <= VISITORS << (64 // m)), 2)


def cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    ends = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits of which at most ``radius`` are set."""
    return np.array([sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


BALL = len(ball(64, BITS // 2))


def _visit(segments: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, value, fp, own): the values that each fingerprint has or visits."""
    balls = [ball(width, r) for (_, width), r in zip(cuts(segments), radii(segments, bits), strict=True)]
    for batch in batches:
        every = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(every), 4096):
            fps = every[at : at + 4096]
            for k, (shift, width) in enumerate(cuts(segments)):
                own = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                values = own[:, None] ^ balls[k][None, :]
                row, col = np.nonzero(values <= own[:, None])
                yield pa.record_batch([pa.array(np.full(len(row), k, np.int32)), pa.array(values[row, col].view(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(col == 0)], ["segment", "value", "vid", "own"])


def joined(fps: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join the visitors of a value as its links do: pairs of two of its own, or of one with a visitor, at ``bits`` or less.

    Rows that are joined already are passed over, so a dense crowd is one sweep and gives one link a row.
    """
    n, root = len(fps), np.arange(len(fps))
    out_a, out_b = [], []
    left = np.flatnonzero(own)
    for i in left.tolist():
        for at in range(0, n, BLOCK):
            others = slice(at, min(n, at + BLOCK))
            near = np.bitwise_count(fps[others] ^ fps[i]) <= bits
            near &= root[others] != root[i]
            for j in (at + np.flatnonzero(near)).tolist():
                a, b = int(root[i]), int(root[j])
                if a != b:
                    root[root == b] = a
                    out_a.append(i)
                    out_b.append(j)
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _meet(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, ["segment", "value"]):
        if rows.num_rows > 1:
            fps, own = rows.column("vid").to_numpy(), rows.column("own").to_numpy(zero_copy_only=False)
            a, b = joined(fps.view(np.uint64), own, bits)
            if len(a):
                yield pa.record_batch([pa.array(fps[a]), pa.array(fps[b])], ["a", "b"])


def _points(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = ball(64, bits // 2)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 64):
            some = fps[at : at + 64]
            yield pa.record_batch([pa.array((some[:, None] ^ masks[None, :]).ravel().view(np.int64)), pa.array(np.repeat(some, len(masks)).view(np.int64))], ["point", "vid"])


def links(vids: DataFrame, bits: int = BITS, segments: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join ``vids`` (one column, distinct, written) as all pairs at ``bits`` or fewer differing bits do."""
    if bits % 2:
        raise ValueError("bits must be even: half of them is the radius of the balls of a crowd")
    m = segments or segments_for(vids.count())
    visits = vids.mapInArrow(partial(_visit, m, bits), "segment int, value long, vid long, own boolean")
    keys = ["segment", "value"]
    crowds = cut(visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(*keys))
    some, full = visits, not crowds.isEmpty()
    if full:
        some = visits.join(crowds, keys, "left_anti")
    found = some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_meet, bits), "a long, b long")
    if full:
        dense = cut(visits.join(crowds, keys, "left_semi").select("vid").distinct())
        points = dense.mapInArrow(partial(_points, bits), "point long, vid long")
        before = points.select("vid", F.lag("vid").over(Window.partitionBy("point").orderBy("vid")).alias("before"))
        found = found.union(before.where("before is not null").select("before", "vid"))
    return found.distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, segments: int | None = None, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    rows = cut(fingerprints(docs, id_col, text_col))
    vertices = cut(rows.groupBy("vid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    roots = components(links(vertices.select("vid"), bits, segments, crowd)).withColumnRenamed("node", "vid")
    joined_ = vertices.join(roots, "vid")
    least = joined_.groupBy("root").agg(F.min("rep").alias("component"))
    of = cut(vertices.join(joined_.select("vid", "root"), "vid", "left").join(least, "root", "left").select("vid", "copies", F.coalesce("component", "rep").alias("component")))
    return _of_rows(rows, of).select("doc_id", F.lpad(F.lower(F.hex("vid")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
