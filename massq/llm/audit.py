"""How filters that are applied one after another hide each other's work.

A document's failures are a set of filters. For any order of the filters it leaves
at the first one that it fails, so all that matters of a row is its set. One pass
over the texts counts rows by part, set and label; the rest is arithmetic on those counts.

The sets of filters applied so far form a lattice: from the empty set, each edge adds
one filter, and an order is a path to the full set. What an edge removes doesn't
depend on how its state was reached. Paths that reach a state are counted forward
from the empty set, paths that leave it backward from the full one; their product
at an edge is the number of orders that take it. Weighted by it, the removals of a
filter's edges sum to its removals over all orders (Shapley's value times the number
of orders), and the steps of an order are read from the same edges.

Copies: the filter ``copies`` takes a row whose text, whole, is that of a smaller id
anywhere in the table, removed or not. Texts are compared by SHA-256. Rows are
summed up by text before they meet, so a text that fills a third of the table is
a few rows by then.

Edge cases: a null text is an empty one, without words, and may be a copy; a null id
is smaller than none and above none, so it fails no copy test and has no label; rows that repeat an id
and text are copies of smaller ids only, not of each other; a null part is the empty
string; several labels for an id count if any says so; a very long text is one row
like any other; an empty table has no parts and no rows. Only the id, text and part
columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massq.llm.common import text_of, words_of

#: Filters at most: their orders are listed, and a cell meets every edge of the lattice.
MOST = 7


def contract_filters(text: Column, words: Column) -> dict[str, Column]:
    """Name and failure condition of the filters that look at one text alone."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(
    docs: DataFrame, labels: DataFrame, filters: Callable[[Column, Column], dict[str, Column]] = contract_filters, copies: str | None = "E",
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> tuple[DataFrame, list[str]]:
    """(part, mask, good, toxic, n) and the filters' names; bit k of ``mask`` is set where the k-th filter fails.

    ``labels`` has the columns doc_id, quality and toxic.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    rows = slim.withColumn("words", words_of(F.col("text")))
    tests = filters(F.col("text"), F.col("words"))
    names = [*tests, *[copies] * (copies is not None)]
    if len(names) > MOST or len(set(names)) < len(names):
        raise ValueError(f"{MOST} filters of different names at most")
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(tests.values())), F.lit(0))
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256)) if copies is not None else F.lit(None).cast("binary")
    # Rows without an id have no label; dealing them out by their text keeps them from meeting in one task.
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.hex("sha") if copies is not None else F.col("part")))
    each = rows.select("id", "part", mask.cast("int").alias("mask"), sha.alias("sha")).withColumn("key", key)
    each = each.groupBy("key", "id", "part", "mask", "sha").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").cast("string").alias("key"))
    marks = marks.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = each.join(marks, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    by = ["part", "mask", "good", "toxic"]
    if copies is None:
        return marked.groupBy(*by).agg(F.sum("n").alias("n")), names
    # A text's rows shrink to one for each part and label; of those with the least id one struct is enough, as rows are summed by id.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = marked.groupBy("sha", *by).agg(F.sum("n").alias("n"), least.alias("least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    first = texts.groupBy(F.col("sha")).agg(F.min("least.id").alias("first"), F.collect_list(F.struct(*by, "n", "least", "nameless")).alias("groups"))
    split = first.select("first", F.inline("groups"))
    fresh = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    bit = 1 << len(tests)
    counted = split.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask"), fresh.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - fresh).alias("n")))))
    return counted.groupBy(*by).agg(F.sum("n").alias("n")), names


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Paths from the empty set to each state, and from each state to the full set."""
    full = (1 << n) - 1
    reaching, leaving = [1] + [0] * full, [0] * full + [1]
    for state in range(full + 1):  # a state's number is above those of its subsets
        for k in range(n):
            if not state >> k & 1:
                reaching[state | 1 << k] += reaching[state]
    for state in range(full, -1, -1):
        for k in range(n):
            if not state >> k & 1:
                leaving[state] += leaving[state | 1 << k]
    return reaching, leaving


def edges(found: DataFrame, n: int) -> DataFrame:
    """A row for each part and edge: state (filters applied before), bit (the one applied now), orders that take it, and counts of documents."""
    reaching, leaving = path_counts(n)
    every = [F.struct(F.lit(s).alias("state"), F.lit(1 << k).alias("bit"), F.lit(reaching[s] * leaving[s | 1 << k]).cast("long").alias("orders")) for s in range(1 << n) for k in range(n) if not s >> k & 1]
    met = found.select("*", F.inline(F.array(*every)))
    mask, state, bit = F.col("mask"), F.col("state"), F.col("bit")
    fails, before = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(state) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    now = fails & ~before
    return met.groupBy("part", "state", "bit", "orders").agg(
        total(~fails & ~before).alias("kept"), total(now).alias("removed"), total(fails & before).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(now & F.col("good")).alias("good_lost"), total(now & F.col("toxic")).alias("toxic_lost"),
    )


def shapley(lattice: DataFrame) -> DataFrame:
    """(part, bit, shapley): a filter's removals, summed over all orders."""
    return lattice.groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))


def steps(lattice: DataFrame, names: Sequence[str], orders: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """A row for each part, order and step; ``orders``: sequences of all ``names``, by default every permutation."""
    bits = {name: 1 << k for k, name in enumerate(names)}
    rows = []
    for order in permutations(names) if orders is None else orders:
        state = 0
        for k, name in enumerate(order, 1):
            rows.append(("".join(order), k, state, bits[name]))
            state |= bits[name]
    paths = lattice.sparkSession.createDataFrame(rows, "filter_order string, step int, state int, bit int")
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return lattice.join(F.broadcast(paths), ["state", "bit"]).join(shapley(lattice), ["part", "bit"]).select("part", "filter_order", "step", *counts, "shapley")


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``steps`` for every order of the filters; options as for ``cells``."""
    found, names = cells(docs, labels, **options)
    return steps(edges(found, len(names)), names)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS s,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic
  FROM d),
c AS (SELECT part, s, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o(p) AS (SELECT '' UNION ALL SELECT p || x FROM o, x WHERE length(p) < 5 AND NOT contains(p, x)),
k AS (SELECT p AS filter_order, unnest(range(1, 6))::INTEGER AS step FROM o WHERE length(p) = 5),
m AS (SELECT part, filter_order, step, s, n, good, toxic, substr(filter_order, step, 1) AS now,
        list_has_any(string_split(s, ''), string_split(substr(filter_order, 1, step - 1), '')) AND step > 1 AND s <> '' AS before FROM k, c),
r AS (
  SELECT part, filter_order, step, now, coalesce(sum(n) FILTER (NOT before AND NOT contains(s, now)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT before AND contains(s, now)), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (before AND contains(s, now)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (s = now), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT before AND contains(s, now) AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT before AND contains(s, now) AND toxic), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL)
SELECT * EXCLUDE (now), (sum(removed) OVER (PARTITION BY part, now))::BIGINT AS shapley FROM r
"""
