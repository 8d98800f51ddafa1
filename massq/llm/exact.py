"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. One pass over the texts takes each document's length, SHA-256 and a 64-bit
   fingerprint of its normalised text, in blocks of ``BLOCK`` rows, sorted by fingerprint.
2. A block sends each owner of a range of fingerprints the distinct ones among its
   own, cut to a few bits more than the table has rows, sorted, as Golomb codes of
   the gaps. A text that fills a third of the table costs one code a block.
3. Owners return a bitmap a block: which fingerprints also came from another block.
   The block marks its suspects, those it holds twice itself included.
4. Suspects' texts are shuffled, grouped by their bytes with partial sums before
   the shuffle, so equal fingerprints of different texts part again. While there are ``BROADCAST`` suspect
   fingerprints or fewer, tasks know them all and no other text leaves its reader. With more, every text
   takes part in that grouping, once: to sort out the others first would shuffle them too.

Edge cases: null is the empty text; all texts of white space only are equal to it. Of
equal texts the row with most code points stays, then the smallest doc_id (null
last), then, among rows that repeat an id, the first by block and place. An empty
table gives an empty result. A very long text is hashed and compared whole; it is one row of its block. Only the id and
text columns are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massq.llm.common import BROADCAST, SPACE, cut, sent, text_of

#: Rows in a block, at most, and the bits that number them.
BLOCK_BITS = 17
BLOCK = 1 << BLOCK_BITS
#: Bits of a fingerprint beyond those that number the rows: one false suspect in 2**EXTRA rows.
EXTRA = 20
#: Fingerprints that an owner may expect, and bits for owners on a small table. At 10**11 rows there are 2**16 owners, so a message still holds two fingerprints of a block.
OWNED, LEAST_OWNERS = 1 << 21, 5


def normal(text_col: str) -> Column:
    """The text without white space."""
    return F.regexp_replace(text_of(text_col), SPACE + "+", "")


def golomb(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct numbers under 2**bits as Golomb-Rice codes of their gaps.

    Count and the width of remainders, then all remainders, then all quotients in unary.
    """
    n = len(values)
    width = max(0, bits - max(1, n).bit_length())
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    low = (gaps[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1)
    ends = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    return np.array([n, width], "<i4").tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes() + np.packbits(unary).tobytes()


def ungolomb(code: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(code, "<i4", 2))
    cells = np.unpackbits(np.frombuffer(code, np.uint8, (n * width + 7) // 8, 8))[: n * width].reshape(n, width)
    low = (cells.astype(np.uint64) << np.arange(width, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, offset=8 + (n * width + 7) // 8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(width)) + low, dtype=np.uint64)


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True).sort_values("fp", kind="stable")
        return pd.DataFrame({"block": [(part << 24) + count], "ids": [rows.doc_id.to_numpy()], "missing": [rows.missing.to_numpy()], "ns": [rows.n.to_numpy()], "fps": [rows.fp.to_numpy()], "shas": [b"".join(rows.sha)]})

    for rows in parts:
        while len(rows):
            held.append(rows.iloc[: BLOCK - size])  # places are numbered within a block, so it never holds more
            rows = rows.iloc[BLOCK - size :]
            size += len(held[-1])
            if size == BLOCK:
                yield block()
                count, held, size = count + 1, [], 0
    if size:
        yield block()


def cut_bits(fps: np.ndarray, bits: int) -> np.ndarray:
    return fps.astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)


def _send(bits: int, owner_bits: int):
    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for block, fps in zip(rows.block, rows.fps, strict=True):
                mine = cut_bits(np.sort(np.asarray(fps).astype(np.int64).view(np.uint64)).view(np.int64), bits)
                mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
                owners = (mine >> np.uint64(bits - owner_bits)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
                inner = np.uint64((1 << (bits - owner_bits)) - 1)
                codes = [golomb(part & inner, bits - owner_bits) for part in np.split(mine, starts[1:])]
                yield pd.DataFrame({"owner": owners[starts], "block": block, "code": codes})

    return send


def _answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of an owner: one a block, a bit for each fingerprint that came from several blocks."""
    sent = [ungolomb(c) for c in rows.code]
    every, where, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    twice = np.split((count > 1)[where], np.cumsum([len(s) for s in sent])[:-1])
    return pd.DataFrame({"owner": rows.owner, "block": rows.block, "n": [len(t) for t in twice], "bitmap": [np.packbits(t).tobytes() for t in twice]})


def _mark(bits: int):
    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for block, ids, missing, ns, fps, shas, bitmaps in zip(rows.block, rows.ids, rows.missing, rows.ns, rows.fps, rows.shas, rows.bitmaps, strict=True):
                fps = np.asarray(fps).astype(np.int64)
                kinds, which, count = np.unique(cut_bits(fps, bits), return_inverse=True, return_counts=True)
                flags = np.concatenate([np.unpackbits(np.frombuffer(b["bitmap"], np.uint8))[: b["n"]] for b in sorted(bitmaps, key=lambda b: b["owner"])]).astype(bool)
                suspect = (flags | (count > 1))[which]
                yield pd.DataFrame({"doc_id": ids, "missing": missing, "n": ns, "fp": fps, "sha": [shas[i : i + 32] for i in range(0, len(shas), 32)], "suspect": suspect, "place": (block << BLOCK_BITS) + np.arange(len(fps))})

    return mark


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (code points), fp, sha, place and ``suspect`` of each row; the texts are read once."""
    text = normal(text_col)
    number = F.col(id_col).cast("long")
    slim = docs.select(F.coalesce(number, F.lit(0)).alias("doc_id"), number.isNull().alias("missing"), F.char_length(text_of(text_col)).alias("n"), F.xxhash64(text).alias("fp"), F.unhex(F.sha2(text, 256)).alias("sha"))
    blocks = cut(slim.mapInPandas(_blocks, "block long, ids array<long>, missing array<boolean>, ns array<int>, fps array<long>, shas binary"))
    total = blocks.agg(F.sum(F.size("fps"))).first()[0] or 0
    owner_bits = max(LEAST_OWNERS, math.ceil(math.log2(max(1, total) / OWNED)))
    bits = min(63, max(1, total).bit_length() + EXTRA)
    sent = blocks.select("block", "fps").mapInPandas(_send(bits, min(owner_bits, bits - 1)), "owner long, block long, code binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "owner long, block long, n int, bitmap binary")
    received = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "n", "bitmap")).alias("bitmaps"))
    marked = blocks.join(received, "block").mapInPandas(_mark(bits), "doc_id long, missing boolean, n int, fp long, sha binary, suspect boolean, place long")
    return cut(marked.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing"))


def verified(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sha and group_size of each text that suspects have; the texts themselves are compared.

    Equal fingerprints of different texts part here. Two texts with one SHA-256 would
    leave two groups for it, which is an error rather than a wrong result.
    """
    wanted = cut(rows.where("suspect").select("fp").distinct())
    texts = docs.select(normal(text_col).alias("bytes"))
    if wanted.limit(BROADCAST + 1).count() <= BROADCAST:
        texts = texts.withColumn("fp", F.xxhash64("bytes")).join(F.broadcast(wanted), "fp", "left_semi")
    texts = texts.groupBy("bytes").agg(F.count(F.lit(1)).alias("size")).select(F.unhex(F.sha2("bytes", 256)).alias("sha"), "size")
    one = texts.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("group_size"))
    return one.select("sha", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts with one SHA-256")).cast("long")).otherwise(F.col("group_size")).alias("group_size"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = fingerprints(docs, id_col, text_col)
    best = rows.where("suspect").groupBy("sha").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")).alias("best"))
    found = cut(best.join(verified(docs, rows, id_col, text_col), "sha"))  # its own table, so a sha with a third of all rows is broadcast to or split
    shared = rows.where("suspect").join(found, "sha").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("best.place")).alias("kept"), "sha")
    alone = rows.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.union(shared).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that go, with its own columns.

    Ids of which all rows go are named by the id alone, a number, so the table of them is
    small and texts seldom have to move. Null ids, and ids that also have a row that stays, are
    told apart by their texts. Rows that repeat both are one row in the result.
    """
    found = cut(duplicates(docs, id_col, text_col).select("doc_id", "kept", F.unhex("text_sha256").alias("_x_sha")))
    ids = found.groupBy("doc_id").agg(F.bool_and(~F.col("kept")).alias("every"), F.bool_or(~F.col("kept")).alias("some"))
    gone = cut(ids.where("every and doc_id is not null").select(F.col("doc_id").alias("_x_id")))
    mixed = cut(ids.where("some and (doc_id is null or not every)").select("doc_id"))
    out = docs.withColumn("_x_id", F.col(id_col).cast("long")).join(sent(gone), "_x_id", "left_anti")
    if not mixed.isEmpty():
        key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_x_key")
        rows = found.select(key(F.col("doc_id")), "kept", "_x_sha").join(mixed.select(key(F.col("doc_id"))), "_x_key", "left_semi")
        drop, stay = rows.where("not kept").select("_x_key", "_x_sha").distinct(), rows.where("kept").select("_x_key", "_x_sha")
        both, twice = ["_x_key", "_x_sha"], cut(drop.intersect(stay))
        mine = out.withColumns({"_x_key": key(F.col("_x_id")), "_x_sha": F.unhex(F.sha2(normal(text_col), 256))})
        out = mine.join(cut(drop), both, "left_anti").unionByName(mine.join(twice, both, "left_semi").dropDuplicates(both))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, len(t) AS n, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS k FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, (count(*) OVER (PARTITION BY k))::BIGINT AS group_size,
       row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM n WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
