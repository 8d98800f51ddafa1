"""License scan by diagonal voting.

All rolling word pairs of all texts meet the pairs of the templates in a hash join
(Spark broadcasts the templates: a fixed list, whose size is checked). A match at
text word ``p`` and template word ``t`` is a vote for the diagonal ``p - t``, where
the template would start. Votes are summed by diagonal; neighbouring diagonals,
which insertions and deletions leave, are merged; a span counts if enough of the
template's pairs voted for it. Each vote is verified word by word in the row that
cast it, so an equal hash alone never counts.

Only built-in functions run. One pass reads the texts; votes are few and shuffle by
row, so no key gathers more than one text's votes. Edge cases: null and empty texts
have no words and no labels; repeated rows are scanned each for itself; a very long text
is scanned whole, pair by pair; of spans that overlap all are kept, those that begin together in the
templates' order; an empty table gives an empty result; only the id and text columns are read; templates
under two words are refused. Word pairs meet by 64-bit hashes, and each vote is then compared by its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massq.llm.common import text_of, words_of

#: What separates words here.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
SEPARATOR_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Pairs of these words alone are left out of long templates: they vote everywhere.
COMMON = frozenset("a an and any as be by for from in is it of on or that the this to with".split())
#: Most template pairs that may be broadcast.
MOST_PAIRS = 100_000
#: Join key by which every row gets its own line, votes or not.
ROW = 0


@dataclass(frozen=True)
class Template:
    """A phrase (``exact``: its words consecutively) or a passage (``share`` of its pairs)."""

    label: str
    text: str
    exact: bool = False
    base: bool = False
    share: float = 0.6

    @property
    def words(self) -> list[str]:
        return self.text.lower().split()

    @property
    def pairs(self) -> list[tuple[int, str, str]]:
        w = self.words
        found = [(i, a, b) for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]
        return found if self.exact else [p for p in found if not (p[1] in COMMON and p[2] in COMMON)]


BASE = (
    Template("gpl", "gnu general public license", True, True),
    Template("apache", "apache license", True, True),
    Template("cc-by", "cc by", True, True),
    Template("mit", "mit license", True, True),
)
#: Names of licenses, and opening passages by which they are known.
OWN = (
    Template("apache-2.0", "apache license version 2 0", True),
    Template("gpl-2.0", "gnu general public license version 2", True),
    Template("gpl-3.0", "gnu general public license version 3", True),
    Template("lgpl", "gnu lesser general public license", True),
    Template("agpl", "gnu affero general public license", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("cc-by-sa", "cc by sa", True),
    Template("cc-by-nd", "cc by nd", True),
    Template("cc0", "cc0 1 0 universal", True),
    Template("mpl", "mozilla public license", True),
    Template("bsd", "bsd license", True),
    Template("isc", "isc license", True),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("apache-2.0-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def template_pairs(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = [(k, p, a, b) for k, t in enumerate(templates) for p, a, b in t.pairs]
    if any(len(t.words) < 2 for t in templates) or len(rows) > MOST_PAIRS:
        raise ValueError(f"templates need two words each and {MOST_PAIRS} pairs at most together")
    cells = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("template", "at", "first", "second"), strict=True)]) for r in rows]
    table = spark.range(1).select(F.inline(F.array(*cells))).withColumn("hash", F.xxhash64("first", "second"))
    return table.union(spark.range(1).select(F.lit(-1), F.lit(0), F.lit(""), F.lit(""), F.lit(ROW).cast("long")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + OWN, slack: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, and ``spans``, an array of
    (template, label, base, start, end, share) by start, then template."""
    spark = docs.sparkSession
    # lower() suits since template words are ASCII; of other letters only the Kelvin sign becomes one of A-Z.
    text = F.lower(F.replace(text_of(text_col), F.lit("\u212a"), F.lit("\u2126")))
    words = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(text, SEPARATOR, SEPARATOR_CHARS).alias("words"))
    none = F.array(F.lit(None).cast("string"))
    sides = words.select("doc_id", "row", F.size("words").alias("n"), F.concat(none, "words").alias("before"), F.col("words").alias("after"))
    # Place 0 stands for the row itself; p for the words p - 1 and p.
    places = sides.select("doc_id", "row", "n", F.posexplode(F.arrays_zip("before", "after")).alias("p", "pair"))
    pairs = places.select("doc_id", "row", "n", "p", F.col("pair.before").alias("before"), F.col("pair.after").alias("after"))
    pairs = pairs.withColumn("hash", F.when(F.col("p") > 0, F.xxhash64("before", "after")).otherwise(F.lit(ROW).cast("long")))
    votes = pairs.join(F.broadcast(template_pairs(spark, templates)), "hash").where((F.col("p") == 0) | ((F.col("before") == F.col("first")) & (F.col("after") == F.col("second"))))
    own = F.col("template") == -1
    votes = votes.where(own == (F.col("p") == 0)).select("row", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n")).alias("n"), "template", (F.col("p") - 1 - F.col("at")).alias("diagonal"), (F.col("p") - 1).alias("p"), "at")
    ballots = votes.groupBy("row", "template", "diagonal").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.collect_set("at").alias("ats"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    facts = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.exact).alias("exact"), F.lit(float(len(t.pairs))).alias("pairs"), F.lit(t.share).alias("share")) for t in templates])
    ballots = ballots.withColumn("t", F.when(F.col("template") >= 0, F.element_at(facts, F.col("template") + 1)))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    jump = F.when(F.col("t.exact") | (F.col("diagonal") - F.lag("diagonal").over(line) > slack), 1).otherwise(0)
    merged = ballots.withColumn("jump", jump).withColumn("band", F.sum("jump").over(line))
    spans = merged.groupBy("row", "template", "band").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("t").alias("t"), F.min("diagonal").alias("diagonal"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    share = F.col("votes") / F.col("t.pairs")
    holds = F.when(F.col("t.exact"), share == 1).otherwise(share >= F.col("t.share"))
    found = F.when(holds, F.struct(F.when(F.col("t.exact"), F.col("diagonal")).otherwise(F.col("lo")).cast("long").alias("start"), "template", F.col("t.label").alias("label"), F.col("t.base").alias("base"), (F.col("hi") + 1).cast("long").alias("end"), share.alias("share")))
    return spans.groupBy("row").agg(F.max("n").cast("long").alias("n_words"), F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(found)).alias("spans")).drop("row")


def labels_of(spans) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of(base).alias("base_labels"), labels_of(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
