"""Phrase collocations from counts of the longest windows alone.

Each word of a piece (text between sentence marks or line ends) starts one window: itself
and the words after it as lead columns, up to ``most`` words, padded with nulls where the
piece ends. Windows are the only thing counted over the corpus. Every shorter phrase
is a prefix of the windows that start where it does, so ROLLUP over the lead columns sums up
the counts of all lengths, and of each language's words, from theirs.

1. Words are counted, to learn which begin so many windows that they need several keys:
   those over ``SPREAD``, at most one in 2**20 of all words, so fewer than 2**20 of them.
2. A block of texts counts its own windows and sends one row for each first word (or each part of a
   frequent one), with the rest of its windows in one value.
3. All windows of a first word (or part) meet. There the tail is folded: a phrase that occurs less often than
   asked becomes its own prefix, padded, and its count is kept. No count is lost, and what remains has few rows.
4. ROLLUP over what remains; candidates are cut in two and scored in whole decimals of 38
   digits; a candidate goes if a longer one holds it about as often; each language's best are ranked,
   in parts first.

Edge cases: null and empty texts, and those of marks and white space only, have no words; a null
language is ``und``; repeated rows count each time; ties are ranked by count, then by the phrase's UTF-8 bytes;
a very long text is counted in several blocks, whose ends no window is cut at; an empty table gives an empty result. Only
the text and language columns are read, whatever others there are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massq.llm.common import cut, small_batches

#: Words in the longest phrase, occurrences of a candidate, phrases of a language that are returned.
MOST, LEAST, TOP = 3, 10, 2000
#: A candidate goes if a longer one that holds it has so many percent of its count.
HELD = 50
#: A word that begins more windows than this has several keys.
SPREAD = 1 << 22
#: Tokens of a block.
BLOCK = 1 << 22
#: Rows of a batch that leaves a task.
ROWS = 20_000
#: Parts in which a language's candidates are ranked before they meet.
PARTS = 64

#: Marks and line ends become the end of a piece, a tab a space, A-Z a-z.
_END = b"."
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def tokens(text: bytes | None) -> list[bytes]:
    """A UTF-8 text's words, with an end of piece wherever one is, and at the end."""
    return (text or b"").translate(_TABLE).replace(_END, b" . ").split() + [_END]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """(language, vocabulary, tokens, windows): blocks of one language's tokens as places in the vocabulary (0: end of a piece); so many of the first begin windows of this block."""
    numbers: dict[str, dict[bytes, int]] = {}
    held: dict[str, list[np.ndarray]] = defaultdict(list)
    total = 0

    def places(lang: str, words: list[bytes]) -> np.ndarray:
        if lang not in numbers:
            numbers[lang] = defaultdict(count().__next__)
            numbers[lang][_END]  # noqa: B018  takes 0
        return np.fromiter(map(numbers[lang].__getitem__, words), np.int32, len(words))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found = tokens(text.as_py())
            while len(found) > BLOCK:
                ids = places(lang, found[: BLOCK + most - 1])
                yield lang, list(numbers[lang]), ids, BLOCK
                found = found[BLOCK:]
            held[lang].append(places(lang, found))
            total += len(found)
            if total >= BLOCK:
                for k, parts in held.items():
                    ids = np.concatenate(parts)
                    yield k, list(numbers[k]), ids, len(ids)
                numbers.clear()
                held.clear()
                total = 0
    for k, parts in held.items():
        ids = np.concatenate(parts)
        yield k, list(numbers[k]), ids, len(ids)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, names, ids, n in _blocks(batches, 1):
        seen = np.bincount(ids[:n], minlength=len(names))
        seen[0] = 0
        some = np.flatnonzero(seen)
        for at in range(0, len(some), ROWS):
            part = some[at : at + ROWS]
            yield pa.record_batch([pa.array([lang] * len(part)), pa.array([names[k] for k in part.tolist()], pa.binary()), pa.array(seen[part])], ["lang", "word", "n"])


def windows(ids: np.ndarray, width: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct padded windows that the first ``n`` tokens begin, as rows of places under ``width`` (0: padding), sorted, and their counts."""
    lead, end = [ids], np.zeros(1, ids.dtype)
    for _ in range(most - 1):
        lead.append(np.where(lead[-1] == 0, end, np.concatenate([lead[-1][1:], end])))
    starts = np.flatnonzero(ids[:n])
    lead = [c[starts] for c in lead]
    key, room = lead[0].astype(np.int64), width
    for c in lead[1:]:
        if room > (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1]
            room = len(key)
        key, room = key * width + c, room * width
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return np.stack([c[first] for c in lead], axis=1), counts


def _count(most: int, spread, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, part, once, more): of each first word, the rest of its windows as lines; those seen once, and the others with their counts.

    Part 0 is a word's only one.
    """
    parts_of = spread.value
    for lang, names, ids, n in _blocks(batches, most):
        rows, counts = windows(ids, len(names), n, most)
        part, first = np.zeros(len(rows), np.int64), rows[:, 0]
        for word in np.unique(first).tolist() if parts_of else ():
            if (parts := parts_of.get((lang, names[word]), 1)) > 1:
                lo, hi = np.searchsorted(first, [word, word + 1])
                part[lo:hi] = [1 + xxhash.xxh3_64_intdigest(names[k]) % parts for k in rows[lo:hi, 1].tolist()]
        order = np.lexsort((counts > 1, part, first))
        first, part, rows, counts = first[order], part[order], rows[order], counts[order]
        ends = np.flatnonzero(np.append((first[1:] != first[:-1]) | (part[1:] != part[:-1]), len(first) > 0)) + 1
        starts = np.append(0, ends)[:-1]
        several = np.append(0, np.cumsum(counts > 1))
        middles = ends - (several[ends] - several[starts])
        for at in range(0, len(ends), ROWS):
            here = slice(at, at + ROWS)
            yield _messages(lang, names, most, rows, counts, part, starts[here], middles[here], ends[here])


def _messages(lang: str, names: list[bytes], most: int, rows: np.ndarray, counts: np.ndarray, part: np.ndarray, starts: np.ndarray, middles: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """A row for each stretch of windows, which share the first word and part; from its middle on they were seen several times."""
    base, top = int(starts[0]), int(ends[-1])
    if most == 3:
        lines = [names[b] + b" " + names[c] if c else names[b] if b else b"" for b, c in rows[base:top, 1:].tolist()]
    else:
        lines = [b" ".join([names[k] for k in row if k]) for row in rows[base:top, 1:].tolist()]
    counts = counts[base:top].tolist()
    once, more = [], []
    for a, b, c in zip((starts - base).tolist(), (middles - base).tolist(), (ends - base).tolist(), strict=True):
        once.append(b"\n".join(lines[a:b]) if b > a else None)
        more.append(b"\n".join([b"%b\t%d" % x for x in zip(lines[b:c], counts[b:c], strict=True)]) if c > b else None)
    columns = [pa.array([lang] * len(ends)), pa.array([names[k] for k in rows[starts, 0].tolist()], pa.binary()), pa.array(part[starts]), pa.array(once, pa.binary()), pa.array(more, pa.binary())]
    return pa.record_batch(columns, ["lang", "word", "part", "once", "more"])


def folded(seen: Counter, least: int) -> Counter:
    """Counts of windows, of which those are cut to their longest prefix that occurs ``least`` times.

    A window is the words after the first, joined by spaces; the empty one is the first word alone.
    """
    total: dict[bytes, int] = defaultdict(int)
    for line, n in seen.items():
        total[line.partition(b" ")[0]] += n
    left = {head: Counter() for head, n in total.items() if n >= least and head}
    out = Counter({b"": sum(n for head, n in total.items() if head not in left)})
    if left:
        for line, n in seen.items():
            head, _, tail = line.partition(b" ")
            if head in left:
                left[head][tail] = n
        for head, tails in left.items():
            for tail, n in folded(tails, least).items():
                out[head + b" " + tail if tail else head] = n
    return +out


def _fold(most: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, w1, w2, ..., n): the folded windows. First words that are rarer than asked themselves become one row without words."""
    out: list[tuple[str, list[str | None], int]] = []
    rest: Counter = Counter()

    def batch() -> pa.RecordBatch:
        columns = [pa.array([x[0] for x in out], pa.string()), *(pa.array([x[1][k] for x in out], pa.string()) for k in range(most)), pa.array([x[2] for x in out], pa.int64())]
        return pa.record_batch(columns, ["lang", *(f"w{k + 1}" for k in range(most)), "n"])

    columns = ["lang", "word", "part", "once", "more"]
    rows = (row for part in batches for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True))
    for (lang, word, part), same in groupby(rows, itemgetter(0, 1, 2)):
        same = list(same)
        if part == 0 and len(same) < least:  # else it is no rare word
            n = sum(once.count(b"\n") + 1 for *_, once, _ in same if once is not None) + sum(int(x.rpartition(b"\t")[2]) for *_, more in same if more is not None for x in more.split(b"\n"))
            if n < least:
                rest[lang] += n
                continue
        seen: Counter = Counter()
        for *_, once, more in same:
            seen.update(once.split(b"\n") if once is not None else ())
            for x in more.split(b"\n") if more is not None else ():
                line, _, n = x.rpartition(b"\t")
                seen[line] += int(n)
        for line, n in folded(seen, least).items():
            after = line.decode().split(" ") if line else []
            out.append((lang, [word.decode(), *after, *[None] * (most - 1 - len(after))], n))
        if len(out) >= 10_000:
            yield batch()
            out = []
    out += [(lang, [None] * most, n) for lang, n in rest.items()]
    if out:
        yield batch()


def counted(docs: DataFrame, most: int = MOST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", spread: int = SPREAD) -> DataFrame:
    """(lang, words, n): all phrases of 1 to ``most`` words that occur ``least`` times, and for each language its number of words (an empty array)."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    single = cut(slim.mapInArrow(_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    over = max(spread, total >> 20)
    hot = {(r.lang, bytes(r.word)): -(-r.n // over) for r in single.where(F.col("n") > over).toLocalIterator()}  # fewer than 2**20
    rows = slim.mapInArrow(partial(_count, most, spark.sparkContext.broadcast(hot)), "lang string, word binary, part long, once binary, more binary")
    keys, names = ["lang", "word", "part"], [f"w{k + 1}" for k in range(most)]
    met = rows.repartition(*keys).sortWithinPartitions(*keys)
    left = cut(met.mapInArrow(partial(_fold, most, least), f"lang string, {', '.join(f'{c} string' for c in names)}, n long"))
    level = sum((F.grouping(c) for c in names), F.lit(0))
    sums = left.rollup("lang", *names).agg(F.sum("n").alias("n"), (most - level).alias("length"), F.grouping("lang").alias("all"))
    words = F.slice(F.array(*names), 1, F.col("length"))
    padded = F.exists(words, lambda w: w.isNull())
    return sums.where((F.col("all") == 0) & ((F.col("length") == 0) | (F.col("n") >= least) & ~padded)).select("lang", words.alias("words"), "n")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole decimals: exact up to counts of 10**16."""
    n = lambda c: F.col(c).cast("decimal(19,0)")
    return F.expr(f"(cast(cast({a} as decimal(16,0)) * {a} as decimal(32,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))").cast("long")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, held: int = HELD, **options) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score; options as for ``counted``."""
    found = cut(counted(docs, most, least, **options))
    phrases = found.where(F.size("words") >= 2).withColumnRenamed("n", "a")
    size = F.size("words")
    sides = phrases.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = sides.select("*", F.slice("words", 1, F.col("k")).alias("one"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("other"))
    count_of = lambda name, n: found.select("lang", F.col("words").alias(name), F.col("n").alias(n))
    sides = sides.join(count_of("one", "l"), ["lang", "one"]).join(count_of("other", "r"), ["lang", "other"])
    scored = sides.withColumn("score", _score("a", "l", "r"))
    best = scored.groupBy("lang", "words").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    if most > 2:
        spans = [F.slice("words", i, j) for j in range(2, most) for i in range(1, most - j + 2)]
        inner = F.filter(F.array(*spans), lambda x: (F.size(x) < size) & (F.size(x) >= 2))
        holders = phrases.where(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("words"), F.col("a").alias("more"))
        best = best.join(holders.groupBy("lang", "words").agg(F.max("more").alias("more")), ["lang", "words"], "left")
        best = best.where(F.col("more").isNull() | (100 * F.col("more") < held * F.col("a")))
    rows = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = some.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where(F.size("words") == 0).select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
x AS (SELECT lang, ws[i:i + k - 1] AS p, k FROM g, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, p, k, count(*)::HUGEINT AS f FROM x GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
s AS (
  SELECT c.lang, c.p, c.k, c.f AS a, h AS h, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS h FROM c) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:h] JOIN f r ON r.lang = c.lang AND r.p = c.p[h + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, h) = 1),
k AS (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k = 3 AND b.k = 2 AND (c.p[1:2] = b.p OR c.p[2:3] = b.p) AND 100 * c.f >= 50 * b.a)),
o AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM k),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT z.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""
