"""Quality classifier: a regularised quadratic discriminant.

Document statistics, squashed to bounded values, are taken by built-in functions in
one pass over the texts. Labelled rows outside the held-out fold, some ``SAMPLE`` of them
picked by a hash of the id where there are more, are summed up by class
into count, sums and sums of products, a few hundred numbers whatever the
input's size; only those reach the driver. Each class covariance is shrunk towards
the identity in units of the pooled deviations. With its Cholesky factor, computed once,
the Mahalanobis distance is a triangular product, which the score expression holds
as plain arithmetic: no function of ours runs on executors.

Edge cases: null and empty texts have statistics of 0 and a score like any other;
rows without a label, or with a null one, teach nothing; repeated label rows count
each; with fewer than two labelled rows of a class the score is that of the prior;
an empty table gives an empty result; a very long text is measured whole. Columns starting with ``_f_`` must not be in the
input of ``statistics``; elsewhere names may clash with ours.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massq.llm.common import cut, remainder, text_of, words_of
from massq.llm.rules import STOP_WORDS

#: Labelled ids that the model is fitted on, about: a bound on rows that teach, and on what is broadcast. Every document gets a score.
SAMPLE = 100_000
#: Share of the identity in a class covariance.
SHRINKAGE = 0.1
#: Scores from here on count as good.
CUT = 0.7
#: The log-density difference is divided by this before it becomes a probability: statistics aren't independent samples of a Gaussian.
TEMPERATURE = 2.0


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_f_``: an array of bounded statistics."""
    text, words = F.col("_f_text"), F.col("_f_words")
    rows = docs.withColumn("_f_text", text_of(text_col)).withColumn("_f_words", words_of(F.col("_f_text")))
    n, chars = F.size(words).cast("double"), F.char_length(text).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    counts = {
        "n": n,
        "chars": chars,
        "upper": count(r"\p{Lu}"),
        "bang": count("!"),
        "symbol": count(r"[#*$%&|<>@~^_=+{}\[\]]"),
        "digit": count(r"\p{Nd}"),
        "stop": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("double"),
        "distinct": F.size(F.array_distinct(words)).cast("double"),
        "again": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b), lambda same: same)).cast("double"),
        "mark": count(r"[.,;:?]"),
        "line": count("\n"),
    }
    rows = rows.withColumns({f"_f_{k}": v for k, v in counts.items()}).drop("_f_text", "_f_words")
    c = lambda k: F.col(f"_f_{k}")
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1.0))
    squash = lambda x, at: x / (x + F.lit(at))
    features = [
        squash(share("upper", "chars"), 0.1),
        squash(share("bang", "n"), 0.2),
        squash(share("symbol", "n"), 0.2),
        squash(share("digit", "chars"), 0.05),
        squash(share("stop", "n"), 0.2),
        share("distinct", "n"),
        squash(share("again", "n"), 0.1),
        squash(share("mark", "n"), 0.15),
        squash(share("line", "n"), 0.05),
        squash(share("chars", "n"), 6.0),
        squash(F.log1p(c("n")), 5.0),
    ]
    return rows.withColumn("_f_", F.array(*features)).drop(*[f"_f_{k}" for k in counts])


@dataclass(frozen=True)
class Discriminant:
    """Of classes 0 and 1: log prior, mean, whitening matrix, log determinant."""

    priors: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray

    def score(self, features: Column) -> Column:
        """Probability of class 1 as an expression."""
        d = self.means.shape[1]
        sides = []
        for k in (0, 1):
            # Inverse Cholesky factor times (x - mean): one sum for each row, the mean's part in its constant.
            shift = self.factors[k] @ self.means[k]
            terms = []
            for i in range(d):
                row = reduce(lambda a, b: a + b, [F.get(features, j) * F.lit(float(self.factors[k][i, j])) for j in range(i + 1)]) - F.lit(float(shift[i]))
                terms.append(F.pow(row, F.lit(2.0)))
            distance = reduce(lambda a, b: a + b, terms)
            sides.append(F.lit(float(self.priors[k] - 0.5 * self.logdets[k])) - distance * 0.5)
        margin = (sides[1] - sides[0]) / TEMPERATURE
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(margin, F.lit(-500.0)), F.lit(500.0))))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From rows (``_f_``, ``label`` 0 or 1, ``weight``). Only sums by class come to the driver."""
    d = 11
    x = [F.get("_f_", i) for i in range(d)]
    w = F.col("weight")
    sums = [F.sum(a * w) for a in x] + [F.sum(x[i] * x[j] * w) for i in range(d) for j in range(i + 1)]
    found = labelled.groupBy("label").agg(F.sum(w).alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)]).collect()
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    low = np.tril_indices(d)
    for row in found:
        k = int(row.label)
        n[k], s[k] = row.n, row[2 : 2 + d]
        ss[k][low] = row[2 + d :]
        ss[k] = ss[k] + np.tril(ss[k], -1).T
    priors = np.log((n + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(priors, np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2))
    means = s / n[:, None]
    cov = np.array([ss[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = np.einsum("k,kii->i", n / n.sum(), cov)
    unit = np.sqrt(np.maximum(pooled, 1e-6))
    factors, logdets = [], []
    for k in (0, 1):
        scaled = cov[k] / np.outer(unit, unit)
        chol = np.linalg.cholesky((1 - shrinkage) * scaled + shrinkage * np.eye(d))
        factors.append(np.linalg.inv(chol) / unit[None, :])
        logdets.append(2 * np.log(np.diag(chol)).sum())
    return Discriminant(priors, means, np.array(factors), np.array(logdets))


def known_labels(labels: DataFrame, id_col: str, label_col: str, fold: tuple[int, int], sample: int = SAMPLE) -> DataFrame:
    """(_f_id, label, weight): labels outside the held-out fold, of about ``sample`` ids; a label's weight is how often it stands there."""
    rows = labels.select(F.col(id_col).alias("_f_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_f_id").isNotNull())
    rows = cut(rows.where(remainder("_f_id", fold[0]) != fold[1]).groupBy("_f_id", "label").agg(F.count(F.lit(1)).alias("weight")))
    share = sample / max(1, rows.select("_f_id").distinct().count())
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64(F.lit("sample"), "_f_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``fold`` (modulus, remainder) of crc32(id) is held out of learning.
    """
    rows = cut(statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "_f_", (remainder("doc_id", fold[0]) == fold[1]).alias("held_out")))
    known = known_labels(labels, id_col, label_col, fold)
    model = fit(rows.join(F.broadcast(known), F.col("doc_id") == F.col("_f_id")))  # about SAMPLE ids
    score = model.score(F.col("_f_"))
    return rows.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the classifier rejects, their own columns only. Texts don't move.

    Only labelled texts, about SAMPLE, are looked at for the fit: their ids are broadcast.
    """
    known = known_labels(labels, id_col, "quality", (4, 2))
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_f_id"))
    model = fit(cut(statistics(labelled).select("_f_", "label", "weight")))
    rows = statistics(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")))
    return rows.where(model.score(F.col("_f_")) >= CUT).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
