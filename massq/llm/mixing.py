"""Mixing sources to target weights by hash-threshold histograms.

Every document has a pseudo-random place on a line, its id's MD5. A source whose
target is ``copies`` whole passes plus a rest takes the documents before a
threshold once more. The thresholds come from nested histograms: sizes summed by
source and leading digits; only the bucket that the budget ends in is split by the
next digits. No sort of documents takes place, and the state is a row per source, which
one task orders: some millions of sources, not as many as documents.

Edge cases: a null text has size 0; a null source is a source of its own, last in
order; rows that repeat an id stand at the same place and are taken together; an
empty table gives an empty result. Every name of the input may clash with ours:
only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massq.llm.common import cut, n_words_of, text_of

#: Hexadecimal digits of a histogram level (4096 buckets), and of a whole place.
STEP, PLACE = 3, 15


def place(id_col: str) -> Column:
    return F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, PLACE)


def source_key(source_col: str) -> Column:
    """A key without nulls that keeps the order by code point and puts null last."""
    return F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("_mix_key"), n_words_of(text_of(text_col)).alias("size"), place(id_col).alias("_mix_place"))


def targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Water-filling in closed form over one row per source (``key``, ``source_size``).

    With sources by rising limit per weight, the first whose limit lies above the
    level that is left for it and those after it sets the level for them all.
    """
    n = len(weights)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % n + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    ranked = totals.withColumn("_rank", F.row_number().over(everything.orderBy("key")) - 1).withColumn("_weight", cycle)
    ranked = ranked.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    before = everything.orderBy(F.col("_limit") / F.col("_weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w=everything: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    level = (total(F.col("source_size").cast("double")) - total("_limit", before)) / (total("_weight") - total("_weight", before))
    ranked = ranked.withColumn("_level", level)
    reached = F.max(F.when(F.col("_limit") > F.col("_level") * F.col("_weight"), F.col("_level"))).over(everything)
    return ranked.select("key", "source_size", F.coalesce(F.least("_limit", F.col("_weight") * reached), F.col("_limit")).alias("target"))


def fit_mix(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """One row per source: size, target, whole copies, and the threshold of the rest."""

    def histogram(rows: DataFrame, digits: int) -> DataFrame:
        return rows.groupBy("_mix_key", F.substring("_mix_place", 1, digits).alias("bucket")).agg(F.sum("size").alias("n"), F.min("_mix_place").alias("lo"), F.max("_mix_place").alias("hi"))

    first = cut(histogram(sizes, STEP))
    plan = targets(first.groupBy(F.col("_mix_key").alias("key")).agg(F.sum("n").alias("source_size")), weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    bounds = cut(plan.withColumns({"before": F.lit(0).cast("long"), "bucket": F.lit(""), "n": F.lit(0).cast("long"), "lo": F.lit(""), "hi": F.lit("g")}))
    for digits in range(STEP, PLACE + 1, STEP):
        if digits > STEP:  # only the boundary buckets that still hold several places
            inside = sizes.join(bounds.where("lo < hi").select(F.col("key").alias("_mix_key"), "bucket"), "_mix_key").where(F.col("_mix_place").startswith(F.col("bucket")))
            counts = histogram(inside.drop("bucket"), digits)
        else:
            counts = first
        counts = counts.select(F.col("_mix_key").alias("_key"), F.col("bucket").alias("_bucket"), F.col("n").alias("_n"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        running = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        steps = bounds.where("lo < hi").join(counts, F.col("key") == F.col("_key")).withColumn("_before", F.col("before") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
        hit = steps.where(F.col("_before") + F.col("_n") > F.col("budget")).groupBy("key").agg(F.min(F.struct("_bucket", "_before", "_n", "_lo", "_hi")).alias("b"))
        narrowed = F.col("b").isNotNull()
        pick = lambda name: F.when(narrowed, F.col(f"b._{name}")).otherwise(F.col(name)).alias(name)
        ended = F.when(narrowed, F.col("b._hi")).when(F.col("lo") < F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("hi")  # no bucket: nothing to take
        bounds = cut(bounds.join(hit, "key", "left").select("key", "source_size", "target", "copies", "budget", pick("before"), pick("bucket"), pick("n"), pick("lo"), ended))
        if bounds.where("lo < hi").isEmpty():
            break
    whole = F.col("n") < 2 * (F.col("budget") - F.col("before"))  # the place at the boundary goes to the nearer side
    return cut(bounds.select("key", "source_size", "target", "copies", F.when(whole, F.concat("hi", F.lit("g"))).otherwise(F.col("lo")).alias("threshold")))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join ``plan`` on ``_mix_key`` and add ``_mix_copies``; one row per row, no sort."""
    plan = plan.select(F.col("key").alias("_mix_key"), *[F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "copies", "threshold")])
    return rows.join(plan, "_mix_key", "left").withColumn("_mix_copies", F.col("_mix_copies") + (F.col("_mix_place") < F.col("_mix_threshold")).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sizes = cut(sized(docs, id_col, text_col, source_col))
    out = with_plan(sizes, fit_mix(sizes, weights, most))
    return out.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("size") * F.col("_mix_copies")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents themselves, with their own columns, each as often as the mix takes it.

    The plan joins on the source; texts move only if there are too many sources to broadcast.
    """
    plan = fit_mix(cut(sized(docs, id_col, text_col, source_col)), weights, most)
    rows = with_plan(docs.select(F.struct("*").alias("row"), source_key(source_col).alias("_mix_key"), place(id_col).alias("_mix_place")), plan)
    return rows.where("_mix_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS nul, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS place
  FROM documents),
t AS (SELECT nul, s, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (ORDER BY nul, s) - 1) % 3 AS k, 3.0::DOUBLE * source_size AS lim FROM t),
w AS (SELECT *, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER b, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0)) AS lev
      FROM w WINDOW b AS (ORDER BY lim / weight, nul, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, max(CASE WHEN lim > lev * weight THEN lev END) OVER () AS reached FROM l),
p AS (SELECT nul, s, source_size, coalesce(least(lim, weight * reached), lim) AS target FROM g),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM p),
c AS (SELECT nul, s, place, sum(size)::BIGINT AS n FROM d GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY nul, s ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
f AS (SELECT e.nul, e.s, e.place,
             CASE WHEN before + n <= target - copies * source_size THEN 1
                  WHEN before <= target - copies * source_size AND n < 2 * (target - copies * source_size - before) THEN 1 ELSE 0 END AS more
      FROM e JOIN q USING (nul, s))
SELECT d.doc_id, d.size, q.source_size, q.target, d.size * (q.copies + f.more) AS taken
FROM d JOIN q USING (nul, s) JOIN f USING (nul, s, place)
"""
