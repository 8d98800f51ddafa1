"""Byte-level BPE, encoding and decoding, by a segment tree of pair ranks.

A piece of text (a match of the splitting pattern) is a row of byte positions. A leaf
holds the rank of the pair that starts there, a node the leftmost minimum below it,
so the root names the next merge. A merge touches three live positions: the
pair's own, the one that vanishes, and the neighbour before, each a walk to the root.
Pieces under ``SHORT`` bytes of a batch go in step, one merge each at a time, as rows of
one array of trees; a longer one has a tree of its own, n log n whatever it holds.

Vocabularies are files of ranks, read on the driver by the path that the caller gives
and broadcast: their size is fixed (refused beyond ``MOST_RANKS``) and does not grow with
the data. Edge cases: null and empty texts have no ids and decode to nothing;
every other text decodes to its own bytes, whatever characters it holds; no special
tokens exist; repeated rows are encoded each; an empty table gives an empty result. The functions are column
expressions, so other columns don't matter; ``encoded`` replaces those named ``_ids`` and ``_decoded``.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massq.llm.common import small_batches, text_of

MOST_RANKS = 1 << 18
#: Bytes of a piece up to which pieces go in step.
SHORT = 64
#: Pieces that a Python worker remembers, and texts that it works on at a time.
REMEMBERED, STEP = 200_000, 256
_NONE = np.int64(1) << np.int64(40)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if len(tokens) > MOST_RANKS or [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"not {MOST_RANKS} ranks at most, from 0 without gaps, with all single bytes")
    return tokens


class Vocabulary:
    """Tokens, their ids, and which pair of ids merges to which."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens, self.ids, self.pattern = tokens, {t: i for i, t in enumerate(tokens)}, regex.compile(pattern)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {(self.ids[t[:k]] << 20) | self.ids[t[k:]]: i for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.merges = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``_NONE`` where they don't merge."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def in_step(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids (as int32 bytes) of pieces of 2 to ``size`` bytes, a power of two."""
        w, place = len(pieces), np.arange(size)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(w, size)
        token = self.single[raw]
        inside = place[None, :] < lengths[:, None]
        after = np.where(inside, place + 1, size)
        after[place[None, :] + 1 >= lengths[:, None]] = size
        before = np.broadcast_to(place - 1, (w, size)).copy()
        tree = np.full((w, 2 * size), _NONE * size)
        leaves = np.where(place[None, 1:] < lengths[:, None], self.ranks(token[:, :-1], token[:, 1:]), _NONE)
        tree[:, size : 2 * size - 1] = leaves * size + place[:-1]
        for lo in [size >> k for k in range(1, size.bit_length())]:
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = inside.copy()
        todo = np.flatnonzero(tree[:, 1] < _NONE * size)

        def put(rows: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
            node = at + size
            tree[rows, node] = np.where(ranks < _NONE, ranks, _NONE) * size + at
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(todo):
            best = tree[todo, 1]
            p = best % size
            q = after[todo, p]
            token[todo, p] = best // size
            live[todo, q] = False
            beyond = after[todo, q]
            after[todo, p] = beyond
            more = beyond < size
            before[todo[more], beyond[more]] = p[more]
            put(todo, q, np.full(len(todo), _NONE))
            pair = np.full(len(todo), _NONE)
            pair[more] = self.ranks(token[todo[more], p[more]], token[todo[more], beyond[more]])
            put(todo, p, pair)
            o = before[todo, p]
            has = o >= 0
            if has.any():
                rows, o = todo[has], o[has]
                put(rows, o, self.ranks(token[rows, o], token[rows, p[has]]))
            todo = todo[tree[todo, 1] < _NONE * size]
        flat = token[live].astype("<i4")
        ends = np.cumsum(live.sum(axis=1))
        return [part.tobytes() for part in np.split(flat, ends[:-1])]

    def alone(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n, merges = len(piece), self.merges
        size = 1 << (n - 1).bit_length()
        none = int(_NONE) * size
        token = self.single[np.frombuffer(piece, np.uint8)].tolist()
        ranks = self.ranks(np.array(token[:-1]), np.array(token[1:]))
        level = np.full(size, none, np.int64)
        level[: n - 1] = np.where(ranks < _NONE, ranks * size + np.arange(n - 1), none)
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)

        def put(at: int, rank: int | None) -> None:
            node = at + size
            tree[node] = none if rank is None else rank * size + at
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            rank, p = divmod(tree[1], size)
            q = after[p]
            token[p], gone[q] = rank, 1
            beyond = after[p] = after[q]
            put(q, None)
            put(p, merges.get((rank << 20) | token[beyond]) if beyond < n else None)
            if beyond < n:
                before[beyond] = p
            if (o := before[p]) >= 0:
                put(o, merges.get((token[o] << 20) | rank))
        return np.array([t for t, g in zip(token, gone, strict=True) if not g], "<i4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Have the ids of these pieces in ``known``."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ids.get(raw)) is not None:
                self.known[piece] = np.array([whole], "<i4").tobytes()
            elif len(raw) > SHORT:
                self.known[piece] = self.alone(raw)
            else:
                sizes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for size, found in sizes.items():
            for at in range(0, len(found), 8192):
                part = found[at : at + 8192]
                self.known.update(zip([p for p, _ in part], self.in_step([r for _, r in part], size), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
        """Ids of each text as int32 bytes, and how many there are."""
        split, out = self.pattern.findall, []
        for at in range(0, len(texts), STEP):
            pieces = [split(t) if t else [] for t in texts[at : at + STEP]]
            fresh = {p for ps in pieces for p in ps}
            missing = {p for p in fresh if p not in self.known}
            if missing:
                if len(self.known) + len(missing) > REMEMBERED:
                    missing = fresh
                self.learn(missing)
            get = self.known.__getitem__
            out += [b"".join(map(get, ps)) for ps in pieces]
        return out, np.array([len(o) // 4 for o in out], np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids; an id that doesn't exist is an error."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.letters[np.repeat(shift, lengths) + np.arange(total)]


@lru_cache(2)
def _vocabulary(tokens: tuple[bytes, ...], pattern: str) -> Vocabulary:
    return Vocabulary(list(tokens), pattern)


class Tokenizer:
    """``encode`` and ``decode`` of a vocabulary as column functions."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        small_batches(spark)
        shared = spark.sparkContext.broadcast((tuple(read_ranks(path)), pattern))

        def ids_of(texts: pa.Array) -> pa.Array:
            vocabulary, parts, counts = _vocabulary(*shared.value), [], [np.zeros(1, np.int64)]
            for at in range(0, len(texts), STEP):
                ids, n = vocabulary.encode(texts.slice(at, STEP).to_pylist())
                parts.append(b"".join(ids))
                counts.append(n)
            ends = np.cumsum(np.concatenate(counts)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))

        def bytes_of(ids: pa.Array) -> pa.Array:
            vocabulary, ends, values = _vocabulary(*shared.value), ids.offsets.to_numpy(), ids.values
            parts, sizes = [], [np.zeros(1, np.int64)]
            for at in range(0, len(ids), STEP):
                cuts = ends[at : at + STEP + 1]
                flat = values.slice(cuts[0], cuts[-1] - cuts[0]).to_numpy()
                parts.append(vocabulary.decode(flat).tobytes())
                sizes.append(np.diff(np.concatenate([[0], np.cumsum(vocabulary.lengths[flat])])[cuts - cuts[0]]))
            offsets = np.cumsum(np.concatenate(sizes)).astype("<i4")
            return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return ids_of(texts)

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            return bytes_of(ids)

        @F.arrow_udf("ids array<int>, decoded binary")
        def round_trip(texts: pa.Array) -> pa.Array:
            ids = ids_of(texts)
            return pa.StructArray.from_arrays([ids, bytes_of(ids)], ["ids", "decoded"])

        self._encode, self._decode, self._round_trip = encode, decode, round_trip

    def encode(self, text: Column) -> Column:
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        return self._decode(F.coalesce(ids, F.array().cast("array<int>")))


    def round_trip(self, text: Column) -> Column:
        """Struct of the ids of a text and the bytes that the ids stand for, in one pass through Python: one worker a task holds the vocabulary."""
        return self._round_trip(F.coalesce(text, F.lit("")))


def tokenizer(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> Tokenizer:
    """One of the public vocabularies that are installed beside Spark."""
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def encoded(docs: DataFrame, tok: Tokenizer, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_ids`` and ``_decoded``, the bytes that the ids stand for; columns of these two names are replaced, all others stay."""
    both = max([*docs.columns, ""], key=len) + "_both"  # longer than any name there is
    return docs.withColumn(both, tok.round_trip(text_of(text_col))).withColumns({"_ids": F.col(both)["ids"], "_decoded": F.col(both)["decoded"]}).drop(both)


def digests(rows: DataFrame) -> DataFrame:
    joined = F.concat_ws(",", F.col("_ids").cast("array<string>"))
    return rows.withColumns({"n_tokens": F.size("_ids").cast("long"), "ids_sha256": F.sha2(joined.cast("binary"), 256), "decoded_sha256": F.sha2("_decoded", 256)})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encoded(docs, tokenizer(spark))).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
