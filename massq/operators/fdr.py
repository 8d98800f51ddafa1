"""Target-decoy q-values of matches, peptides and proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massq.operators.shared import materialise, running_min_up, running_sums


class FdrError(ValueError):
    """Input from which no q-value follows: empty, without decoys, or with scores that aren't finite."""


def checked(counts: DataFrame, score: str) -> int:
    """Number of distinct scores in a table (score, t, d); raises for input without meaning."""
    odd = F.count_if(F.col(score).isNull() | F.isnan(score) | (F.abs(F.col(score).cast("double")) == float("inf")))
    kinds, bad, decoys = counts.agg(F.count(F.lit(1)), odd, F.sum("d")).first()
    for fails, why in ((kinds == 0, "no rows"), (bad > 0, "scores that aren't finite"), (not decoys, "no decoys")):
        if fails:
            raise FdrError(why)
    return kinds


def with_q(df: DataFrame, score: str = "score", decoy: str = "is_decoy", out: str = "q_value") -> DataFrame:
    """``df`` with q-values: decoys over targets at or above the score, capped at 1, then the least at or below.

    Rows shrink to one a distinct score before anything is ordered, and the ordered
    sums run in buckets, so no task sees all rows; ties share a value by that. Scores join back.
    """
    counts = materialise(df.groupBy(score).agg(F.count_if(~F.col(decoy)).alias("t"), F.count_if(decoy).alias("d")))
    kinds = checked(counts, score)
    sums = running_sums(counts, score, ["t", "d"], descending=True, rows=kinds)
    sums = sums.withColumn("fdr", F.when(F.col("t_run") > 0, F.least(F.lit(1.0), F.col("d_run") / F.col("t_run"))).otherwise(1.0))
    return df.join(running_min_up(sums, score, "fdr", out).select(score, out), score)


def best_per(df: DataFrame, key: str, score: str = "score", decoy: str = "is_decoy", order: str | None = None) -> DataFrame:
    """Best score of each key with the decoy flag of the row that has it (the first in ``order`` on ties)."""
    tie = [F.col(order).alias("o")] if order else []
    return df.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("s"), *tie, F.col(decoy).alias("d"))).alias("m")).select(key, (-F.col("m.s")).alias(score), F.col("m.d").alias(decoy))


def peptide_q(df: DataFrame, peptide: str = "peptide", score: str = "score", decoy: str = "is_decoy") -> DataFrame:
    return with_q(best_per(df, peptide, score, decoy), score, decoy)


def _picked(pairs: DataFrame) -> DataFrame:
    """(base, score, q_value) of targets that beat their decoy, ties to the target; ``pairs``: (base, t, d), best scores of either. 0 without decoy winners."""
    lost = F.coalesce(F.col("t").isNull() | (F.col("d") > F.col("t")), F.lit(False))
    winners = materialise(pairs.select("base", lost.alias("is_decoy"), F.when(lost, F.col("d")).otherwise(F.col("t")).alias("score")))
    scored = winners.withColumn("q_value", F.lit(0.0)) if winners.where("is_decoy").isEmpty() else with_q(winners)
    return scored.where("not is_decoy").select("base", "score", "q_value")


def picked_q(groups: DataFrame, name: str = "leader", score: str = "score", prefix: str = "REV_") -> DataFrame:
    """Targets that beat their decoy (ties to the target) with q-values over all winners; 0 without decoy winners."""
    decoy = F.col(name).startswith(prefix)
    base = F.when(decoy, F.substring(F.col(name), len(prefix) + 1, 1 << 30)).otherwise(F.col(name))
    pairs = groups.groupBy(base.alias("base")).agg(F.max(F.when(~decoy, F.col(score))).alias("t"), F.max(F.when(decoy, F.col(score))).alias("d"))
    return _picked(pairs).withColumnRenamed("base", name)


def picked_peptide_q(matches: DataFrame, peptide: str = "peptide", score: str = "score", decoy: str = "is_decoy") -> DataFrame:
    """(peptide, score, q_value) of target peptides that beat their own reversed form, all but the last residue reversed, before the competition.

    A decoy is reversed once more to find its target, so the pairing needs no table of peptides.
    """
    from massq.operators.digest import reverse_decoy

    base = F.when(F.col(decoy), reverse_decoy(F.col(peptide))).otherwise(F.col(peptide))
    pairs = matches.groupBy(base.alias("base")).agg(F.max(F.when(~F.col(decoy), F.col(score))).alias("t"), F.max(F.when(F.col(decoy), F.col(score))).alias("d"))
    return _picked(pairs).withColumnRenamed("base", peptide)
