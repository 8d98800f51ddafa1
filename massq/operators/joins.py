"""Joins by closeness: bands, nearest in time, overlapping intervals, similar strings.

Spark has no range-join strategy, so each of these turns closeness into equal buckets,
which shuffle and skew-split like any equi-join, and filters exactly afterwards. Only
one side is copied into several buckets, a number fixed by the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massq.functions.exprs import hamming


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def band_join(points: DataFrame, bands: DataFrame, value: str, lo: str, hi: str, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with equal ``keys`` and ``lo <= value <= hi``; ``width`` about that of a band."""
    left = points.withColumn("_b", F.floor(F.col(value) / width))
    right = bands.withColumn("_b", _buckets(F.col(lo), F.col(hi), width))
    return left.join(right, [*keys, "_b"]).where(F.col(value).between(F.col(lo), F.col(hi))).drop("_b")


def ppm_join(observed: DataFrame, theoretical: DataFrame, obs: str, theo: str, ppm: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within a relative tolerance (inclusive, relative to the theoretical value).

    Buckets are equal in the logarithm, so one width serves all masses.
    """
    p, width = ppm * 1e-6, 4 * ppm * 1e-6
    left = observed.where(F.col(obs) > 0).withColumn("_b", F.floor(F.ln(obs) / width))
    t = F.col(theo)
    right = theoretical.where(t > 0).withColumn("_b", _buckets(F.ln(t * (1 - 1.001 * p)), F.ln(t * (1 + 1.001 * p)), width))
    return left.join(right, [*keys, "_b"]).where(F.abs(F.col(obs) - t) / t * 1e6 <= ppm).drop("_b")


def nearest_join(left: DataFrame, right: DataFrame, keys: tuple[tuple[str, str], ...], at: str, right_at: str, tolerance: float, left_id: list[str], order: list[str], accept: Column | None = None) -> DataFrame:
    """For each left row the nearest right one within ``tolerance``; ties by the columns in ``order``.

    ``left_id`` names a left row, ``accept`` is a further condition on the pair. The pick is
    an aggregate with partial sums, so a crowded bucket needs no sort.
    """
    l = left.withColumn("_b", _buckets(F.col(at) - tolerance, F.col(at) + tolerance, 2 * tolerance))  # noqa: E741
    r = right.withColumn("_rb", F.floor(F.col(right_at) / (2 * tolerance)))
    on = [F.col(a) == F.col(b) for a, b in keys] + [F.col("_b") == F.col("_rb")]
    pairs = l.join(r, on).withColumn("_d", F.abs(F.col(at) - F.col(right_at))).where(F.col("_d") <= tolerance)
    if accept is not None:
        pairs = pairs.where(accept)
    best = pairs.groupBy(*left_id).agg(F.min(F.struct("_d", *order)).alias("_m"))
    return best.select(*left_id, F.col("_m._d").alias("distance"), *[F.col(f"_m.{c}").alias(c) for c in order])


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[tuple[str, str], ...], a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of closed intervals that overlap. A pair is kept in the bucket where its overlap begins, so once."""
    l = left.withColumn("_b", _buckets(F.col(a[0]), F.col(a[1]), width))  # noqa: E741
    r = right.withColumn("_rb", _buckets(F.col(b[0]), F.col(b[1]), width))
    on = [F.col(x) == F.col(y) for x, y in keys] + [F.col("_b") == F.col("_rb")]
    start = F.greatest(F.col(a[0]), F.col(b[0]))
    return l.join(r, on).where((start <= F.least(F.col(a[1]), F.col(b[1]))) & (F.floor(start / width) == F.col("_b"))).drop("_b", "_rb")


def _segments(text: Column, most: int) -> Column:
    """(len, i, piece) of ``most + 1`` pieces of a text of at least as many letters, the longer pieces last."""
    n, parts = F.length(text), most + 1
    base, even = F.floor(n / parts).cast("int"), parts - n % parts
    pieces = []
    for i in range(parts):
        start = i * base + F.greatest(F.lit(i) - even, F.lit(0)) + 1
        pieces.append(F.struct(n.alias("len"), F.lit(i).alias("i"), F.substring(text, start, base + (F.lit(i) >= even).cast("int")).alias("piece")))
    return F.when(n >= parts, F.array(*pieces)).otherwise(F.array().cast("array<struct<len:int,i:int,piece:string>>"))


def _probes(text: Column, most: int, slack: int) -> Column:
    """(len, i, piece): where the pieces of a text within ``most`` edits may stand in this one.

    Of ``most + 1`` pieces one is without an edit such that exactly as many edits as pieces come
    before it; so it starts at most i places off, seen from the left, and ``most - i`` seen from the right.
    """
    n, parts, found = F.length(text), most + 1, []
    for shift in range(-min(most, slack), min(most, slack) + 1):
        other = n + shift
        base, even = F.floor(other / parts).cast("int"), parts - other % parts
        for i in range(parts):
            size, start = base + (F.lit(i) >= even).cast("int"), i * base + F.greatest(F.lit(i) - even, F.lit(0)) + 1
            for move in range(max(-i, -shift - (most - i)), min(i, -shift + (most - i)) + 1):
                fits = (other >= parts) & (start + move >= 1) & (start + move + size - 1 <= n)
                found.append(F.when(fits, F.struct(other.alias("len"), F.lit(i).alias("i"), F.substring(text, start + move, size).alias("piece"))))
    return F.array_distinct(F.array_compact(F.array(*found)))


def _remains(text: Column, most: int, longest: int) -> Column:
    """(len -1, i -1, piece) of what a text of at most ``longest`` letters may be once up to ``most`` are deleted."""
    n = F.length(text)
    masks = F.sequence(F.lit(0), F.pow(F.lit(2), F.least(n, F.lit(longest))).cast("int") - 1)
    kept = F.filter(masks, lambda m: n - F.bit_count(m) <= most)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    stays = lambda m, k: F.call_function("shiftright", m, k).bitwiseAND(1) == 1
    left = lambda m: F.array_join(F.transform(F.filter(places, lambda k: stays(m, k)), lambda k: F.substring(text, k + 1, F.lit(1))), "")
    found = F.array_distinct(F.transform(kept, lambda m: F.struct(F.lit(-1).alias("len"), F.lit(-1).alias("i"), left(m).alias("piece"))))
    return F.when(n <= longest, found).otherwise(F.array().cast("array<struct<len:int,i:int,piece:string>>"))


def similar_join(left: DataFrame, right: DataFrame, a: str, b: str, most: int, length_slack: int = 2, keys: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """All pairs of distinct texts (and ``keys``) within an edit distance, identical ones left out.

    The right text is cut into ``most + 1`` pieces, of which an edit distance of ``most`` leaves
    one whole; the left one is looked at where that piece may then stand. Right texts of at most
    ``most`` letters have no such pieces: they meet short left ones on what deletions leave of both.
    Texts are made distinct first, so how often each occurs costs nothing here.
    """
    x, y = F.col(a), F.col("_t")
    l = left.select(*[k for k, _ in keys], a).where(x.isNotNull()).distinct()  # noqa: E741
    r = right.select(*[F.col(k).alias(f"_r_{k}") for _, k in keys], F.col(b).alias("_t")).where(y.isNotNull()).distinct()
    l = l.withColumn("_k", F.explode(F.concat(_probes(x, most, length_slack), _remains(x, most, 2 * most))))  # noqa: E741
    r = r.withColumn("_rk", F.explode(F.concat(_segments(y, most), _remains(y, most, most))))
    on = [F.col(k) == F.col(f"_r_{m}") for k, m in keys] + [F.col("_k") == F.col("_rk"), F.abs(F.length(x) - F.length(y)) <= length_slack, x != y]
    near = l.join(r, on).select(*[k for k, _ in keys], a, "_t", F.levenshtein(x, y, most).alias("distance")).where("distance >= 0").distinct()
    return near.withColumnRenamed("_t", f"{b}_similar")


def hamming_join(left: DataFrame, right: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """All pairs of distinct texts of one length with at most ``most`` mismatches, identical ones left out.

    Of ``most + 1`` pieces at the same places one is equal, so texts meet on those. Texts of
    at most ``most`` letters always match and meet by length; an alphabet has few of them.
    """
    x, y = F.col(a), F.col("_t")

    def pieces(c: Column) -> Column:
        whole = F.array(F.struct(F.length(c).alias("len"), F.lit(-1).alias("i"), F.lit("").alias("piece")))
        return F.explode(F.when(F.length(c) > most, _segments(c, most)).otherwise(whole))

    l = left.select(a).where(x.isNotNull()).distinct().withColumn("_k", pieces(x))  # noqa: E741
    r = right.select(F.col(b).alias("_t")).where(y.isNotNull()).distinct().withColumn("_rk", pieces(y))
    near = l.join(r, (F.col("_k") == F.col("_rk")) & (x != y)).select(a, "_t", hamming(x, y).alias("mismatches"))
    return near.where(F.col("mismatches") <= most).distinct().withColumnRenamed("_t", f"{b}_similar")
