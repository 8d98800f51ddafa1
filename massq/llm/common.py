"""What the operators of this subpackage share: words, shared scratch tables, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massq.operators.shared import materialise as cut
from massq.operators.shared import shared_path as scratch_path

__all__ = ["BROADCAST", "SPACE", "SPACE_CHARS", "WORD", "cut", "n_words_of", "remainder", "scratch_path", "sent", "small_batches", "small_row_groups", "text_of", "words_of"]

#: White space of the query contracts: space and the controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A word: a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark hand texts to Python in batches of at most ``rows``.

    Texts are long, so the default of 10,000 rows fills a worker's memory. It is a setting
    of the session, read when a plan is made; a lower one stays.
    """
    small_row_groups(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def small_row_groups(spark: SparkSession, size: int = 32 << 20) -> None:
    """Have Spark write Parquet in row groups of 32 MB: a writer holds one in memory, and the default of 128 MB takes a task's share of an executor. One that is set stays."""
    if spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", str(size))


#: Rows of numbers or hashes that are sent to every task at most.
BROADCAST = 1 << 21


def sent(keys: DataFrame) -> DataFrame:
    """``keys``, a written table of narrow rows, for a join with texts: to every task while it has BROADCAST rows or fewer, so that no text moves; else Spark chooses."""
    return F.broadcast(keys) if keys.limit(BROADCAST + 1).count() <= BROADCAST else keys


def text_of(col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col), F.lit(""))


#: The characters of SPACE themselves.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words_of(c: Column, space: str = SPACE, chars: str = SPACE_CHARS) -> Column:
    """The words of a text as an array, in order; none of them is empty.

    ``chars`` are the characters of the class ``space``: trimmed off both ends, they
    leave no empty word to filter out.
    """
    bare = F.btrim(c, F.lit(chars))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, space + "+"))


def n_words_of(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus
