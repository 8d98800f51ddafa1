"""Entrapment analysis: tagging, similarity levels, co-elution, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massq.functions import chem
from massq.functions import exprs as X
from massq.functions.chem import RESIDUES
from massq.operators.digest import digest
from massq.operators.joins import similar_join
from massq.operators.shared import materialise


@dataclass(frozen=True)
class Rule:
    """Any of: accessions in ``ids``, substrings, a regular expression."""

    ids: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    regex: str | None = None


@dataclass(frozen=True)
class Config:
    target: Rule
    trap: Rule
    conflict: str = "prefer_target"
    unmatched: str = "ignore"
    max_edits: int = 2
    length_slack: int = 2
    delta_mass: float = 1.0
    missed: int = 2
    levels: tuple[str, ...] = field(default=("L2", "L3", "L4"))

    def __post_init__(self):
        if not all(r.ids or r.contains or r.regex for r in (self.target, self.trap)):
            raise ValueError("target and trap need a rule each")
        if self.conflict not in ("prefer_target", "prefer_trap", "mark_ambiguous") or self.unmatched not in ("ignore", "target", "trap", "error"):
            raise ValueError("unknown conflict or unmatched policy")


def _fits(accession: Column, rule: Rule) -> Column:
    found = F.lit(False)
    if rule.ids:
        found = found | accession.isin(*rule.ids)
    for s in rule.contains:
        found = found | accession.contains(s)
    return found | accession.rlike(rule.regex) if rule.regex else found


def group_of(protein_ids: Column, config: Config) -> Column:
    """target, trap or ambiguous for ``;``-separated accessions. Without a rule that fits, ``ignore`` means target."""
    each = F.transform(F.split(protein_ids, ";"), lambda x: F.trim(x))
    target, trap = F.exists(each, lambda a: _fits(a, config.target)), F.exists(each, lambda a: _fits(a, config.trap))
    both = {"prefer_target": "target", "prefer_trap": "trap", "mark_ambiguous": "ambiguous"}[config.conflict]
    rest = F.raise_error(F.concat(F.lit("no rule fits "), protein_ids)).cast("string") if config.unmatched == "error" else F.lit({"ignore": "target"}.get(config.unmatched, config.unmatched))
    return F.when(target & trap, both).when(target, "target").when(trap, "trap").otherwise(rest)


def tag_by_sets(psms: DataFrame, sets: DataFrame, id_col: str = "protein_ids") -> DataFrame:
    """Flags ``in_target``, ``in_trap`` from accession tables (accession, kind) too large for a rule's list."""
    each = psms.select(id_col).distinct().select(id_col, F.explode(F.transform(F.split(id_col, ";"), lambda x: F.trim(x))).alias("accession"))
    hits = each.join(sets, "accession").groupBy(id_col).agg(F.max(F.col("kind") == "target").alias("in_target"), F.max(F.col("kind") == "trap").alias("in_trap"))
    return psms.join(hits, id_col, "left").fillna(False, ["in_target", "in_trap"])


def target_index(proteins: DataFrame, config: Config) -> DataFrame:
    """Distinct target peptides with the first protein that has each, and their forms with I as L."""
    rows = digest(proteins, "trypsin", config.missed, 6, 50)
    first = rows.groupBy("peptide").agg(F.min(F.struct("accession", "ord"))["accession"].alias("protein"))
    return first.withColumn("folded", X.fold_il(F.col("peptide")))


def align(a: str, b: str) -> tuple[int, str, float]:
    """Edit distance, operations (``N3→D``, ``ins:G@5``, ``del:G@5``) and their mass; going back, substitutions before insertions before deletions."""
    n, m = len(a), len(b)
    d = [list(range(m + 1))] + [[i] + [0] * m for i in range(1, n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i][j - 1] + 1, d[i - 1][j] + 1)
    ops, mass, i, j = [], 0.0, n, m
    of = lambda c: RESIDUES.get(c, 0.0)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            if a[i - 1] != b[j - 1]:
                ops.append(f"{a[i - 1]}{i - 1}→{b[j - 1]}")
                mass += of(b[j - 1]) - of(a[i - 1])
            i, j = i - 1, j - 1
        elif j and d[i][j] == d[i][j - 1] + 1:
            ops.append(f"ins:{b[j - 1]}@{i}")
            mass += of(b[j - 1])
            j -= 1
        else:
            ops.append(f"del:{a[i - 1]}@{i - 1}")
            mass -= of(a[i - 1])
            i -= 1
    return d[n][m], ",".join(reversed(ops)), mass


@F.pandas_udf(T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("detail", T.StringType()), T.StructField("delta_mass", T.DoubleType())]))
def alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(x, y) for x, y in zip(a, b, strict=True)], columns=["distance", "detail", "delta_mass"])


def classify_peptides(peptides: DataFrame, index: DataFrame, config: Config) -> DataFrame:
    """One row per distinct peptide: level and its best target.

    L0 an exact target, L1 one but for I and L, L2 and L3 within the edits (by mass
    difference under or over the threshold), L4 none. Same-length targets compete by
    mismatches, others by edits; fewer edits win, then the smaller mass change.
    """
    distinct = materialise(peptides.select("peptide").distinct())
    exact = index.select("peptide", F.col("protein").alias("exact_protein"))
    folded = index.groupBy("folded").agg(F.min(F.struct("peptide", "protein")).alias("same"))
    near = similar_join(distinct, index, "peptide", "peptide", config.max_edits, config.length_slack)
    near = near.where(X.fold_il(F.col("peptide")) != X.fold_il(F.col("peptide_similar")))
    diffs = X.differences(F.col("peptide"), F.col("peptide_similar"))
    same_length = F.length("peptide") == F.length("peptide_similar")
    near = near.withColumn("diffs", diffs)
    edits = F.when(same_length, F.size("diffs")).otherwise(F.col("distance"))
    mass = chem.residue_sum(F.col("peptide_similar")) - chem.residue_sum(F.col("peptide"))  # whatever the alignment
    near = near.withColumns({"edits": edits, "dm": F.round(mass, 9)}).where(F.col("edits") <= config.max_edits)
    shorter = F.when(F.length("peptide") < F.length("peptide_similar"), F.col("peptide")).otherwise(F.col("peptide_similar"))
    longer = F.when(F.length("peptide") < F.length("peptide_similar"), F.col("peptide_similar")).otherwise(F.col("peptide"))
    kind = X.substitution_category(F.col("diffs"), X.isobaric_dipeptide(shorter, longer), F.col("dm"), config.delta_mass)
    ranked = F.struct("edits", F.abs("dm").alias("adm"), (~same_length).alias("cross"), F.col("peptide_similar").alias("target"), "dm", kind.alias("kind"))
    best = near.groupBy("peptide").agg(F.min(ranked).alias("b"))
    crossed = best.where("b.cross").select("peptide", alignment("peptide", "b.target")["detail"].alias("detail"))  # only the best ones, and of other length
    best = best.join(crossed, "peptide", "left")
    rows = distinct.join(exact, "peptide", "left").withColumn("folded", X.fold_il(F.col("peptide"))).join(folded, "folded", "left").join(best, "peptide", "left")
    l0, l1, hit = F.col("exact_protein").isNotNull(), F.col("same").isNotNull(), F.col("b").isNotNull()
    level = F.when(l0, "L0").when(l1, "L1").when(hit & (F.col("b.adm") < config.delta_mass), "L2").when(hit, "L3").otherwise("L4")
    target = F.when(l0, F.col("peptide")).when(l1, F.col("same.peptide")).otherwise(F.col("b.target"))
    own = ~l0 & ~l1 & hit
    return rows.select("peptide", level.alias("level"), target.alias("best_target"), F.when(own, F.col("b.edits")).when(l0 | l1, 0).alias("edit_distance"), F.when(own, F.col("b.dm")).when(l0 | l1, 0.0).alias("delta_mass"), F.when(own, F.col("b.kind")).alias("substitution"), F.when(own, F.col("detail")).alias("detail"))


def classify(psms: DataFrame, index: DataFrame, config: Config) -> DataFrame:
    """Matches with group and level; only traps are compared, all others are L4."""
    tagged = psms.withColumn("group", group_of(F.col("protein_ids"), config))
    found = classify_peptides(tagged.where("group = 'trap'"), index, config)
    out = tagged.join(found, "peptide", "left")
    return out.withColumn("level", F.when(F.col("group") == "trap", F.col("level")).otherwise("L4"))


def statistics(classified: DataFrame) -> DataFrame:
    """Counts and mass changes by group and level."""
    return classified.groupBy("group", "level").agg(F.count(F.lit(1)).alias("n"), F.count("delta_mass").alias("n_mass"), F.min("delta_mass").alias("mass_min"), F.max("delta_mass").alias("mass_max"), F.avg("delta_mass").alias("mass_mean"))


def top_families(classified: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent families of exact (L0) traps: by count, then name."""
    hits = classified.where((F.col("group") == "trap") & (F.col("level") == "L0"))
    return hits.groupBy(X.family_name(F.col("protein_ids")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.min("peptide").alias("example")).orderBy(F.desc("n"), "family").limit(n)


def co_eluting(traps: DataFrame, others: DataFrame, windows: DataFrame, most: int = 20, width: float = 0.5) -> DataFrame:
    """Other peptides of a run whose elution overlaps a trap's, in the same DIA window (the first that contains each).

    Both sides: (id, run, peptide, precursor_mz, rt_start, rt_stop). ``most`` rows by start, then id.
    """
    from massq.operators.joins import overlap_join

    def placed(d: DataFrame, prefix: str) -> DataFrame:
        w = windows.select(F.col("run").alias("_run"), "target", (F.col("target") - F.col("lower")).alias("_lo"), (F.col("target") + F.col("upper")).alias("_hi"))
        hit = d.join(w, (F.col("run") == F.col("_run")) & F.col("precursor_mz").between(F.col("_lo"), F.col("_hi")))
        first = hit.groupBy("id").agg(F.min("target").alias("window"))
        d = d.join(first, "id")
        return d.select(*[F.col(c).alias(f"{prefix}{c}") for c in d.columns])

    pairs = overlap_join(placed(traps, "t_"), placed(others, "o_"), (("t_run", "o_run"), ("t_window", "o_window")), ("t_rt_start", "t_rt_stop"), ("o_rt_start", "o_rt_stop"), width)
    pairs = pairs.where(F.col("t_peptide") != F.col("o_peptide"))
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy("o_rt_start", "o_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)
