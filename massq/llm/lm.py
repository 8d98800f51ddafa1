"""Language-model scores by deleted interpolation of n-gram estimates.

A token's probability after the two before it mixes two: the trigram's maximum likelihood
and the lower model, which mixes the bigram's, the unigram's and a uniform one over
the vocabulary. The weights depend on the bucket (half a power of two, so that one and two
differ) of how often the context occurs: the pair before for trigrams, the token before for the
rest. A document's first token has no pair before it and takes the lower model. They are
learned by expectation-maximisation on a deleted part of the training documents, with
counts from the rest, the lower model first; the scores then use the counts of all training documents.

Exchange: tasks cut the tokens into blocks of a bounded number (``BLOCK``), as 64-bit word hashes.
A block asks each owner of a range of hashes of words or of n-grams for the ones it holds, once each,
sorted and packed, with its own counts. Owners add up what all blocks sent and
answer in the same order. So a frequent pair costs one number a block, a rare
one a few bytes, and no task holds more than a block or an owner's range.
Hashes of n-grams are cut to ``EXTRA`` bits more than number all tokens' n-grams, so one never
seen is taken for a seen one at most once in 2**EXTRA; words keep all 64 bits.
The weights are learned from histograms whose size the quantisation of their axes bounds.

Edge cases: null and empty texts are the end token alone; a word unseen in training
costs what the uniform estimate gives; without training documents only the
uniform estimate is left (one kind, so a probability of 1) and base_score is that of the
formula with N = V = 0; repeated rows are counted and scored each; a document longer than a
block is a block of its own; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massq.llm.common import cut, remainder, small_batches
from massq.llm.near import _ASCII_LOWER, mixed

#: Tokens of a block, about, and n-grams of an owner, about.
BLOCK, OWNED = 1 << 20, 1 << 20
#: Folds of crc32(id) mod FOLDS: HELD is scored only, DELETED teaches the weights, the others count for both.
FOLDS, HELD, DELETED = 10, 0, 1
#: Bits of an n-gram's hash beyond those that number all n-grams, and how many fewer bits tell the owners of words, which are fewer.
EXTRA, WORD_OWNERS = 20, 2
#: Histogram axes: buckets of contexts, and steps of a quarter of a bit of probability; the last step is zero.
BUCKETS, STEPS = 80, 257
ROUNDS = 60
_END = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "zstd"


def _pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: planes of zeros cost next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T) if len(values) else np.empty(0, np.uint8)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec=_PACKED, asbytes=True)


def _unpack(packed: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=n * width, codec=_PACKED), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK tokens: ids and folds of documents, tokens of each, and all tokens as places in the block's list of word hashes."""
    from pyspark import TaskContext

    part, count = TaskContext.get().partitionId(), 0
    ids, folds, sizes, hashes, held = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        kinds, where, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return pa.record_batch(
            [pa.array([(part << 32) + count]), pa.array([ids], pa.list_(pa.int64())), pa.array([folds], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_pack(rank[where])]), pa.array([_pack(kinds[order])])],
            ["block", "ids", "folds", "sizes", "tokens", "words"],
        )

    for batch in batches:
        for doc, fold, text in zip(batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), batch.column("text"), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
            found = np.empty(len(words) + 1, np.uint64)
            found[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            found[-1] = _END
            ids.append(doc)
            folds.append(fold)
            sizes.append(len(found))
            hashes.append(found)
            held += len(found)
            if held >= BLOCK:
                yield block()
                ids, folds, sizes, hashes, held, count = [], [], [], [], 0, count + 1
    if ids:
        yield block()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, since each holds a block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class Block:
    """A block's sorted distinct words and n-grams, and where each token's are among them."""

    def __init__(self, row: dict, bits: int):
        self.folds, self.sizes = np.asarray(row["folds"]), np.asarray(row["sizes"])
        place, words = _unpack(row["tokens"], np.uint32).astype(np.int32), _unpack(row["words"], np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(place)
        before[1:] = place[:-1]
        before[self.starts] = place[self.starts[0] + self.sizes[0] - 1]  # each document follows an end
        self.place, self.before = place, before
        later = np.ones(len(place), bool)
        later[self.starts] = False
        self.inner = np.flatnonzero(later).astype(np.int32)  # tokens that have a pair before them
        pairs = mixed(mixed(words[before] * np.uint64(0xD6E8FEB86659FD93)) + words[place])
        triples = mixed(mixed(pairs[self.inner - 1] * np.uint64(0xA0761D6478BD642F)) + words[place[self.inner]])
        both = np.concatenate([pairs, triples])
        del pairs, triples
        both >>= np.uint64(64 - bits)
        self.grams, which = np.unique(both, return_inverse=True)
        del both
        which = which.astype(np.int32)
        self.pair, self.triple = which[: len(place)], which[len(place) :]
        self.context = self.pair[self.inner - 1]
        keys = mixed(words)
        order = np.argsort(keys, kind="stable")
        self.words = keys[order]
        self.word_at = np.empty(len(order), np.int64)
        self.word_at[order] = np.arange(len(order))

    def counts(self, of_fold: np.ndarray) -> np.ndarray:
        """Of each word, then of each n-gram, in documents of the folds that are marked."""
        mine = np.repeat(of_fold[self.folds], self.sizes)
        words = np.empty(len(self.words), np.int64)
        words[self.word_at] = np.bincount(self.place[mine], minlength=len(words))
        of = lambda which: np.bincount(which, minlength=len(self.grams))
        return np.concatenate([words, of(self.pair[mine]) + of(self.triple[mine[self.inner]])])


_KEPT = np.array([f not in (HELD, DELETED) for f in range(FOLDS)])
_GONE = np.array([f == DELETED for f in range(FOLDS)])


def _requests(bits: int, owner_bits: int):
    """Messages of a block: owners of words come first, in the order of the block's own counts."""
    word_bits = max(0, owner_bits - WORD_OWNERS)

    def owners(keys: np.ndarray, width: int, first: int) -> np.ndarray:
        return (keys >> np.uint64(width - first)).astype(np.int64) if first else np.zeros(len(keys), np.int64)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, bits)
            to = np.concatenate([owners(b.words, 64, word_bits), (1 << owner_bits) + owners(b.grams, bits, owner_bits)])
            cuts = np.flatnonzero(np.diff(to)) + 1
            parts = [np.split(x, cuts) for x in (np.concatenate([b.words, b.grams]), b.counts(_KEPT).astype(np.uint32), b.counts(_GONE).astype(np.uint32))]
            out = [[int(to[at]), to[at] < 1 << owner_bits, row["block"], _pack(np.diff(k, prepend=np.uint64(0))), _pack(x), _pack(y)] for at, k, x, y in zip([0, *cuts], *parts, strict=True)]
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["owner", "word", "block", "keys", "kept", "gone"])

    return requests


def _answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over all blocks, to each in its own order, those of the kept part only for what its deleted part holds; and in the first row the owner's tokens and kinds of words."""
    sent = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    kinds, where = np.unique(np.concatenate(sent), return_inverse=True)
    gone = np.concatenate([_unpack(x, np.uint32) for x in rows.gone])
    kept = np.bincount(where, np.concatenate([_unpack(x, np.uint32) for x in rows.kept]), len(kinds)).astype(np.int64)
    every = kept + np.bincount(where, gone, len(kinds)).astype(np.int64)
    cuts = np.cumsum([len(s) for s in sent])[:-1]
    totals = [int(every.sum()), int((every > 0).sum()), int(kept.sum())] if rows.word.iloc[0] else [0, 0, 0]
    width = np.uint32 if every.max(initial=0) < 1 << 32 else np.uint64
    out_every = [_pack(part) for part in np.split(every.astype(width)[where], cuts)]
    out_kept = [_pack(part[held > 0]) for part, held in zip(np.split(kept.astype(width)[where], cuts), np.split(gone, cuts), strict=True)]
    first = [[t] + [0] * (len(rows) - 1) for t in totals]
    return pd.DataFrame({"owner": rows.owner, "block": rows.block, "wide": width is np.uint64, "every": out_every, "kept": out_kept, "tokens": first[0], "kinds": first[1], "kept_tokens": first[2]})


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The deleted documents of each block, as a block of their own; its words and n-grams are those that owners answer for the kept part."""
    for row in _rows(batches):
        folds, sizes = np.asarray(row["folds"]), np.asarray(row["sizes"])
        mine = _GONE[folds]
        if mine.any():
            used, where = np.unique(_unpack(row["tokens"], np.uint32)[np.repeat(mine, sizes)], return_inverse=True)
            tokens, words = _pack(where.astype(np.uint32)), _pack(_unpack(row["words"], np.uint64)[used])
            yield pa.record_batch([pa.array([row["block"]]), pa.array([folds[mine]], pa.list_(pa.int32())), pa.array([sizes[mine]], pa.list_(pa.int32())), pa.array([tokens]), pa.array([words])], ["block", "folds", "sizes", "tokens", "words"])


def _answers(row: dict, name: str) -> np.ndarray:
    return np.concatenate([_unpack(a[name], np.uint64 if a["wide"] else np.uint32).astype(np.float64) for a in sorted(row["answers"], key=lambda a: a["owner"])])


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(b, a.shape) > 0)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum((2 * np.log2(context + 1)).astype(np.int8), BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(np.round(-4 * np.log2(np.maximum(p, 1e-300))), STEPS - 2), STEPS - 1).astype(np.int64)


class Estimates:
    """Counts that owners answered for a block's tokens, and maximum likelihoods from them."""

    def __init__(self, row: dict, field: str, bits: int, tokens: int):
        self.block = b = Block(row, bits)
        counts = _answers(row, field)
        self.words, grams = counts[: len(b.words)][b.word_at], counts[len(b.words) :]
        context = self.words[b.before]
        self.bucket, self.two, self.one = _bucket(context), _ratio(grams[b.pair], context), _ratio(self.words, float(tokens))[b.place]
        self.context = grams[b.context]  # of the tokens in block.inner, as is ``three``
        self.three = _ratio(grams[b.triple], self.context)

    def lower(self, weights: np.ndarray, uniform: float) -> np.ndarray:
        p = weights[:, 2][self.bucket] * uniform
        p += weights[:, 1][self.bucket] * self.one
        p += weights[:, 0][self.bucket] * self.two
        return p


def _histogram(bits: int, kept_tokens: int, weights: np.ndarray | None = None, uniform: float = 0.0):
    """Deleted tokens by bucket and steps of two estimates from the rest: of bigram and unigram, or given the lower model's weights of trigram and lower model."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            e = Estimates(row, "kept", bits, kept_tokens)
            if weights is None:
                bucket, high, low = e.bucket, e.two, e.one
            else:
                bucket, high, low = _bucket(e.context), e.three, e.lower(weights, uniform)[e.block.inner]
            cells, n = np.unique((bucket.astype(np.int64) * STEPS + _step(high)) * STEPS + _step(low), return_counts=True)
            yield pa.record_batch([pa.array(cells), pa.array(n)], ["cell", "n"])

    return histogram


def learn_weights(cells: np.ndarray, n: np.ndarray, uniform: float | None = None) -> np.ndarray:
    """By bucket the weights of the higher and the lower estimate of a histogram and, if it is given, of a uniform one."""
    probability = np.append(np.exp2(-np.arange(STEPS - 1) / 4), 0.0)
    bucket, parts = cells // STEPS**2, [probability[cells // STEPS % STEPS], probability[cells % STEPS]]
    parts = np.stack(parts if uniform is None else [*parts, np.full(len(cells), uniform)], axis=1)
    weights = np.tile([0.5, 0.5] if uniform is None else [0.4, 0.4, 0.2], (BUCKETS, 1))
    for _ in range(ROUNDS):
        share = parts * weights[bucket]
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(parts.shape[1])], axis=1) + 0.01
        weights = sums / sums.sum(axis=1, keepdims=True)
    if uniform is None:
        weights[0] = [0, 1]  # a pair never seen says nothing
    return weights


def _score(bits: int, lower: np.ndarray, top: np.ndarray, tokens: int, kinds: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            e = Estimates(row, "every", bits, tokens)
            b, p = e.block, e.lower(lower, 1 / (kinds + 1))
            bucket = _bucket(e.context)
            p[b.inner] = top[:, 0][bucket] * e.three + top[:, 1][bucket] * p[b.inner]
            base = np.log10((e.words + 0.1) / (tokens + 0.1 * (kinds + 1)))
            total = lambda x: np.add.reduceat(x, b.starts)
            known = total((e.words > 0)[b.place].astype(np.int64))
            yield pa.record_batch(
                [pa.array(row["ids"], pa.int64()), pa.array(b.folds == HELD), pa.array(b.sizes.astype(np.int64)), pa.array(known), pa.array(total(base[b.place])), pa.array(total(np.log10(p)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), remainder(id_col, FOLDS).cast("int").alias("fold"))
    blocks = cut(slim.mapInArrow(_blocks, "block long, ids array<long>, folds array<int>, sizes array<int>, tokens binary, words binary"))
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = min(64, (2 * size + 1).bit_length() + EXTRA)
    owner_bits = max(3, int(np.ceil(np.log2(max(1.0, 2 * size / OWNED)))))
    sent = blocks.mapInArrow(_requests(bits, owner_bits), "owner long, word boolean, block long, keys binary, kept binary, gone binary")
    answers = cut(sent.groupBy("owner").applyInPandas(_answer, "owner long, block long, wide boolean, every binary, kept binary, tokens long, kinds long, kept_tokens long"))
    totals = answers.agg(F.sum("tokens"), F.sum("kinds"), F.sum("kept_tokens")).first()
    tokens, kinds, kept_tokens = (int(x or 0) for x in totals)

    def received(rows: DataFrame, field: str) -> DataFrame:
        by_block = answers.where(F.length(field) > 8).groupBy("block").agg(F.collect_list(F.struct("owner", "wide", field)).alias("answers"))  # eight bytes pack none
        return rows.join(by_block, "block")

    gone = blocks.where(F.array_contains("folds", DELETED)).mapInArrow(_deleted, "block long, folds array<int>, sizes array<int>, tokens binary, words binary")
    deleted, uniform = cut(received(gone, "kept")), 1 / (kinds + 1)

    def weights(histogram, *low: float) -> np.ndarray:
        cells = deleted.mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        return learn_weights(cells.cell.to_numpy(np.int64), cells.n.to_numpy(np.float64), *low)

    lower = weights(_histogram(bits, kept_tokens), uniform)
    top = weights(_histogram(bits, kept_tokens, lower, uniform))
    out = received(blocks, "every").mapInArrow(_score(bits, lower, top, tokens, kinds), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
