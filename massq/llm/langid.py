"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of 0 to ``ORDER`` bytes holds how often each byte
followed. A byte costs -log2 of its share in the longest context that has seen it, plus
an escape for every longer one that hasn't: with n followers, d of them different,
escaping has probability d / (n + d). The language whose frozen tree codes the
text in fewest bits wins.

Trees are learned from a bounded sample: of each language about ``SAMPLE`` documents outside
the held-out fold, all when it has fewer, picked by a hash of the id, with their whole
texts. Byte n-grams are counted in tasks and summed in Spark; the trees, whose size the
sample bounds, come to the driver, become one hash table of code lengths and are
broadcast. Whole texts are scored, in slices of a bounded number of bytes.

Every language takes a column of the table, whatever it has seen, so many languages get a smaller sample each (``MOST_CELLS``).

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is
everything when nothing could be learned; rows with a null language teach nothing; ties
go to the first language by code point; repeated rows are scored each; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massq.llm.common import cut, remainder, small_batches, text_of

#: Bytes of the longest context.
ORDER = 3
#: Documents that teach a language, about.
SAMPLE = 2000
#: Languages that one model may tell apart.
MOST_LANGS = 1000
#: Longest contexts times languages: the table of code lengths has 8 bytes for each, on the driver and in each task.
MOST_CELLS = 1 << 25
#: Bytes scored at a time.
SLICE = 1 << 20


def grams(raw: np.ndarray, order: int) -> np.ndarray:
    """At each byte the ``order`` before it and itself as one number; before the text stand zero bytes."""
    padded = np.concatenate([np.zeros(order, np.uint8), raw]).astype(np.uint32)
    out = np.zeros(len(raw), np.uint32)
    for k in range(order + 1):
        out = (out << np.uint32(8)) | padded[k : k + len(raw)]
    return out


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            by.setdefault(lang, []).append(grams(_bytes(text.as_py()), ORDER))
        for lang, found in by.items():
            kinds, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.astype(np.int64)), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])


class Model:
    """Code lengths of all languages for every context that any of them has seen."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        shorter = None
        for order in range(ORDER + 1):  # from no context to the longest; a shorter gram is the end of a longer one
            mask = np.uint32(0xFFFFFFFF >> (8 * (ORDER - order)))
            per = []
            for kinds, n in counts:
                g, where = np.unique(kinds & mask, return_inverse=True)
                per.append((g, np.bincount(where, n, len(g))))
            every = np.unique(np.concatenate([g for g, _ in per])) if per else np.empty(0, np.uint32)
            contexts = np.unique(every >> np.uint32(8))
            escape = np.zeros((len(contexts), len(langs)))
            bits = np.zeros((len(every), len(langs)))
            inner = (every & (mask >> np.uint32(8))) if order else every
            for k, (g, n) in enumerate(per):
                at = np.searchsorted(contexts, g >> np.uint32(8))
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                known = total > 0
                escape[known, k] = np.log2((total + kinds)[known] / kinds[known])
                mine = np.searchsorted(every, g)
                seen = np.zeros(len(every), bool)
                seen[mine] = True
                bits[mine, k] = np.log2((total + kinds)[at] / n)
                rest = ~seen
                below = 8.0 if shorter is None else self._bits(inner[rest], order - 1)[:, k]
                bits[rest, k] = escape[np.searchsorted(contexts, every[rest] >> np.uint32(8)), k] + below
            self.levels.append((every, bits, contexts, escape))
            shorter = order
        self.table = _Table(self.levels[-1][0]) if langs else None
        self.lengths = self.levels[-1][1].astype(np.float32) if langs else None

    def _bits(self, g: np.ndarray, order: int) -> np.ndarray:
        """Bits of grams of an order, seen or not, a column a language."""
        every, bits, contexts, escape = self.levels[order]
        at = np.minimum(np.searchsorted(every, g), len(every) - 1)
        out = bits[at]
        new = every[at] != g
        if new.any():
            fresh = g[new]
            c = fresh >> np.uint32(8)
            where = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            cost = np.where((contexts[where] == c)[:, None], escape[where], 0.0)
            out[new] = cost + (self._bits(fresh & np.uint32(0xFFFFFFFF >> (8 * (ORDER - order + 1))), order - 1) if order else 8.0)
        return out

    def total(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of the texts that begin at ``starts`` in ``raw``, each after ORDER zero bytes."""
        out = np.zeros((len(starts), len(self.langs)))
        for at in range(0, len(raw), SLICE):
            g = grams(raw[max(0, at - ORDER) : at + SLICE], ORDER)[at - max(0, at - ORDER) :]
            slot = self.table.find(g)
            bits = self.lengths[np.maximum(slot, 0)].astype(np.float64)
            new = slot < 0
            if new.any():
                bits[new] = self._bits(g[new], ORDER)
            first = np.searchsorted(starts, at, "right") - 1
            cuts = np.unique(np.concatenate([[0], starts[(starts > at) & (starts < at + len(g))] - at]))
            out[first : first + len(cuts)] += np.add.reduceat(bits, cuts, axis=0)
        return out


class _Table:
    """Open hash table from 32-bit keys to their places."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint32(32 - max(10, (4 * len(keys)).bit_length()))
        size = 1 << (32 - int(self.shift))
        self.keys, self.slots = keys, np.full(size + 64, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(left):
            place = home[left] + step
            if step == 64:
                raise ValueError("hash table too full")
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            left = left[self.slots[place] != left]
            step += 1
        self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, g: np.ndarray) -> np.ndarray:
        place = self._home(g)
        out = self.slots[place]
        todo = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != g))
        for step in range(1, self.steps + 1):
            if not len(todo):
                break
            found = self.slots[place[todo] + step]
            out[todo] = found
            todo = todo[(found >= 0) & (self.keys[np.maximum(found, 0)] != g[todo])]
        out[todo] = -1
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From rows (doc_id, text, lang), which may teach all. Where many languages would make the table larger than MOST_CELLS, half the sample is taken, and half again."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return Model([], [])
    place = F.crc32(F.concat(F.lit("sample "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1 << 32, int((1 << 32) * sample / n)))])
    some = known.where(place < F.element_at(limits, F.col("lang"))).select("lang", "text")
    counts = cut(some.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    if sample > 1 and counts.select("gram").distinct().count() * len(sizes) > MOST_CELLS:
        return learn(docs, sample // 2)
    counted = counts.toArrow()
    langs, lang = sorted(sizes), counted.column("lang").to_numpy()
    gram, n = counted.column("gram").to_numpy().astype(np.uint32), counted.column("n").to_numpy().astype(np.float64)
    langs = [x for x in langs if (lang == x).any()]
    return Model(langs, [(gram[lang == x], n[lang == x]) for x in langs])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: tuple[int, int] = (4, 2), sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (probability under equal priors)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("held_out", remainder("doc_id", fold[0]) == fold[1])
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows.where("not held_out"), sample))

    @F.arrow_udf("lang string, score double")
    def best(texts: pa.Array) -> pa.Array:
        model = shared.value
        if not model.langs:
            return pa.StructArray.from_arrays([pa.array([None] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))], ["lang", "score"])
        raws = [np.concatenate([np.zeros(ORDER, np.uint8), _bytes(t.as_py())]) for t in texts]
        ends = np.cumsum([len(r) for r in raws])
        bits = model.total(np.concatenate(raws), ends - [len(r) for r in raws]) if raws else np.zeros((0, len(model.langs)))
        which = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([model.langs[k] for k in which], pa.string()), pa.array(score)], ["lang", "score"])

    has = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    found = rows.withColumn("best", best(text_of()))
    named = has & F.col("best.lang").isNotNull()
    return found.select("doc_id", "held_out", F.when(named, F.col("best.lang")).otherwise("und").alias("lang_pred"), F.when(named, F.col("best.score")).otherwise(0.0).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
