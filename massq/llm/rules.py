"""Quality rules: a table of thresholds compiled into one projection.

``METRICS`` names each measure and the built-in expression that computes it;
``THRESHOLDS`` gives the range that a document must keep to. ``judge`` compiles both
into a single select: no shuffle, no user function, a row out for each row in.

Edge cases: a null text is an empty one, has no words and fails ``n_words``; ratios
of nothing are 0; repeated rows are judged each for itself; a very long text is measured whole, in
arrays of its words and windows; an empty table gives an empty result. Windows of eight words are told apart by 64-bit
hashes: a text of n words takes two different windows for one with a chance of n**2 / 2**65. Other columns of the
input pass through ``judge`` untouched, whose names may be any that don't start with ``_q_`` or ``_verdict``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massq.llm.common import SPACE_CHARS, WORD, text_of, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "the of and to in a is that for it was on are as with by be this from or have an they which at not but "
    "le la les de des du et en un une est que qui dans pour par sur au aux avec pas ce il "
    "der die das und den von zu mit sich ist im dem nicht ein eine auf als auch es an "
    "el los las y del se por con para su al lo como más".split()
)
#: metric, least, most (null: no bound). ``base`` rules are the fixed part of the contract.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("repeat_share", None, 0.3),
    ("mean_word_length", 1.5, 20),
    ("symbol_ratio", None, 0.35),
    ("bang_ratio", None, 0.5),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
)
BASE_RULES = ("n_words", "repeat_share")


def repeated_words(hashes: str) -> Column:
    """Positions covered by windows that occur twice or more; ``hashes``: one per window, in order.

    A set decides first whether anything repeats at all. Only then are hashes sorted
    with their places, so equal ones are neighbours, and the places' spans united.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  evaluates value once
    same = lambda a, j, h: F.coalesce(F.get(a, j)["h"] == h, F.lit(False))
    starts = let(placed, lambda a: F.array_sort(F.transform(F.filter(a, lambda x, i: same(a, i - 1, x["h"]) | same(a, i + 1, x["h"])), lambda x: x["i"])))
    united = let(starts, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), united).otherwise(0)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, each in a column whose name starts with ``_q_``."""
    text = F.col("_q_text")
    rows = docs.withColumn("_q_text", text_of(text_col))
    rows = rows.withColumns({"_q_words": words_of(text), "_q_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))})
    n = F.size("_q_words")
    # A window's hash by doubling: of 2 words, then of 4, then of all 8. Ends without a full window are cut off.
    paired = lambda c, step: F.zip_with(c, F.slice(c, step + 1, F.size(c)), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("_q_hashes", paired("_q_words", 1)).withColumn("_q_hashes", paired("_q_hashes", 2)).withColumn("_q_hashes", paired("_q_hashes", 4))
    rows = rows.withColumn("_q_hashes", F.slice("_q_hashes", 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    counts = {
        "n_words": n,
        "word_chars": F.char_length(F.translate(text, SPACE_CHARS, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": repeated_words("_q_hashes"),
        "n_lines": F.size("_q_lines"),
        "n_bangs": F.regexp_count(text, F.lit("!")),
        "n_stops": F.size(F.filter("_q_words", lambda w: F.lower(w).isin(*STOP_WORDS))),
    }
    return rows.withColumns({f"_q_{k}": c.cast("long") for k, c in counts.items()}).drop("_q_text", "_q_words", "_q_lines", "_q_hashes")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(f"_q_{b}") > 0, F.col(f"_q_{a}") / F.col(f"_q_{b}")).otherwise(0.0)


METRICS = {
    "n_words": lambda: F.col("_q_n_words"),
    "repeat_share": lambda: _ratio("n_repeat_words", "n_words"),
    "mean_word_length": lambda: _ratio("word_chars", "n_words"),
    "symbol_ratio": lambda: _ratio("n_symbols", "n_words"),
    "bang_ratio": lambda: _ratio("n_bangs", "n_words"),
    "stop_ratio": lambda: _ratio("n_stops", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
}


def fails(metric: str, least: float | None, most: float | None) -> Column:
    """Whether a document is outside a rule's range. Shares are compared as whole numbers where the contract says so."""
    if metric == "repeat_share" and most is not None:
        return 100 * F.col("_q_n_repeat_words") > round(100 * most) * F.col("_q_n_words")
    value = METRICS[metric]()
    bounds = [value < least] * (least is not None) + [value > most] * (most is not None)
    return reduce(lambda a, b: a | b, bounds, F.lit(False))


def judge(docs: DataFrame, thresholds=THRESHOLDS, base_rules=BASE_RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts (``_q_...``) and ``_verdict`` (base_failed, kept, failed: names of the rules broken)."""
    rows = measured(docs, text_col)
    broken = {m: fails(m, lo, hi) for m, lo, hi in thresholds}
    base = reduce(lambda a, b: a | b, [broken[m] for m in base_rules if m in broken], F.lit(False))
    every = reduce(lambda a, b: a | b, broken.values(), F.lit(False))
    names = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in broken.items()]))
    return rows.withColumn("_verdict", F.struct(base.alias("base_failed"), (~every).alias("kept"), names.alias("failed")))


def query(spark, sf_dir: str) -> DataFrame:
    rows = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *counts, "_verdict.base_failed", "_verdict.kept")


_W = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, r, t, {_W} AS ws FROM d),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
n AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM n),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g),
u AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) - i AS gap FROM h WHERE c > 1),
v AS (SELECT r, sum(least(8, coalesce(gap, 8)))::BIGINT AS nr FROM u GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(nr, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '!')) AS n_bangs,
         len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) AS n_stops
  FROM w JOIN l USING (r) LEFT JOIN v USING (r)),
x AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 1.5 * n_words OR word_chars > 20 * n_words OR n_symbols::DOUBLE / n_words > 0.35
            OR n_bangs::DOUBLE / n_words > 0.5 OR n_stops::DOUBLE / n_words < 0.01 OR (n_lines > 0 AND n_dup_lines::DOUBLE / n_lines > 0.5)) AS kept
FROM x
"""
