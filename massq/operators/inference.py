"""Protein inference: grouping, subsets, parsimony, razor peptides, coverage."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massq.functions.exprs import fold_il, is_decoy, passes_q
from massq.operators import occurrences
from massq.operators.shared import materialise

#: Pairs of group and peptide that one task may cover.
LOCAL = 200_000
#: Share of the pairs beyond which a round that leaves them has dropped few.
KEEP = 0.8
#: Share of the groups, first keys first, that are covered before the others are looked at.
AHEAD = 1 / 16


def hits(psms: DataFrame, q_threshold: float | None = 0.01) -> DataFrame:
    """(peptide with I as L, score, protein) of each match; rows without a q-value stay."""
    rows = psms if q_threshold is None else psms.where(passes_q(F.col("q_value"), q_threshold))
    return rows.select(fold_il(F.col("peptide")).alias("peptide"), "score", F.explode("accessions").alias("protein"))


def edges(psms: DataFrame, q_threshold: float | None = 0.01) -> DataFrame:
    """``hits`` with the best score of each pair."""
    return hits(psms, q_threshold).groupBy("peptide", "protein").agg(F.max("score").alias("score"))


def indistinguishable(pairs: DataFrame) -> DataFrame:
    """Proteins with one peptide set: members (sorted), peptides (sorted), score, first, size. A pair may come more than once."""
    sets = pairs.groupBy("protein").agg(F.sort_array(F.collect_set("peptide")).alias("peptides"), F.max("score").alias("score"))
    groups = sets.groupBy("peptides").agg(F.sort_array(F.collect_set("protein")).alias("members"), F.max("score").alias("score"))
    return groups.withColumns({"first": F.element_at("members", 1), "size": F.size("peptides")})


def _marks(peptides: str) -> Column:
    """A set as 64 bits, one of which each member sets: a subset's bits are among its superset's."""
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(p), F.lit(64)).cast("int"))
    return F.aggregate(peptides, F.lit(0).cast("long"), lambda t, p: t.bitwiseOR(bit(p)))


def subset_links(groups: DataFrame) -> DataFrame:
    """(sub, super): each strict subset with the first of its supersets, the largest, then the first by name.

    A superset must hold the subset's rarest peptide, so groups meet on that one alone
    and not on every peptide they share; a group with a peptide of its own is no subset. What meets are 64 bits of each set;
    arrays join only those pairs whose bits allow it.
    """
    g = groups.select("first", "size", "peptides")
    each = g.select("first", "size", _marks("peptides").alias("marks"), F.explode("peptides").alias("peptide"))
    largest = F.min(F.struct((-F.col("size")).alias("s"), F.col("first").alias("super")))["super"]
    shared = each.groupBy("peptide").agg(F.count(F.lit(1)).alias("n"), largest.alias("super")).where("n > 1")
    # A spot is a peptide's count and its hash: where two peptides share one, pairs too many meet, which the arrays tell apart.
    spot = F.shiftleft("n", 32) + F.xxhash64("peptide").bitwiseAND(F.lit((1 << 32) - 1))
    keyed = materialise(each.join(shared, "peptide").select("first", "size", "marks", spot.alias("spot"), F.when(F.col("size") == 1, F.col("super")).alias("super")))
    # A peptide alone is a subset of all its holders, so the largest of them is known; only sets of two and more meet.
    alone = keyed.where("size = 1").select(F.col("first").alias("sub"), "super")
    keyed = keyed.where("size > 1").drop("super")
    rarest = keyed.groupBy("first", "size", "marks").agg(F.min("spot").alias("spot"), F.count(F.lit(1)).alias("n")).where("n = size")
    holders = keyed.select(F.col("first").alias("super"), F.col("size").alias("super_size"), F.col("marks").alias("super_marks"), "spot")
    fits = (F.col("size") < F.col("super_size")) & (F.col("marks").bitwiseAND(F.bitwise_not("super_marks")) == 0)
    pairs = rarest.withColumnRenamed("first", "sub").join(holders, "spot").where(fits).select("sub", "super", "super_size")
    pairs = pairs.join(g.select(F.col("first").alias("sub"), F.col("peptides").alias("small")), "sub").join(g.select(F.col("first").alias("super"), F.col("peptides").alias("large")), "super")
    pairs = pairs.where(F.size(F.array_except("small", "large")) == 0)
    return pairs.groupBy("sub").agg(F.min(F.struct((-F.col("super_size")).alias("s"), "super"))["super"].alias("super")).unionByName(alone)


def without_subsets(groups: DataFrame) -> DataFrame:
    """Groups that are no strict subset, with the members of those merged into them."""
    links = materialise(subset_links(groups))
    members = links.join(groups.select(F.col("first").alias("sub"), "members"), "sub")
    gained = members.groupBy(F.col("super").alias("first")).agg(F.flatten(F.collect_list("members")).alias("gained"))
    # A superset is the largest, so no subset itself: a group has gained members, or goes, or neither.
    known = gained.unionByName(links.select(F.col("sub").alias("first"), F.lit(None).cast("array<string>").alias("gained")))
    kept = groups.join(known.withColumn("known", F.lit(True)), "first", "left").where(F.col("known").isNull() | F.col("gained").isNotNull())
    return kept.withColumn("members", F.sort_array(F.array_distinct(F.concat("members", F.coalesce("gained", F.array().cast("array<string>")))))).drop("known", "gained")


def _cover(rows: pd.DataFrame, total: int, last: int) -> pd.DataFrame:
    """Greedy set cover of what is left, up to the key ``last``: a heap of gains that are looked at again when they come up."""
    of = rows.groupby("id").agg({"peptide": list, "own": "first"})
    heap, left, chosen = [(-len(ps) - own, g) for g, ps, own in zip(of.index, of.peptide, of.own, strict=True)], set(rows.peptide), []
    heapq.heapify(heap)
    while heap:
        gain, g = heapq.heappop(heap)
        now = of.own[g] + sum(p in left for p in of.peptide[g])
        if now == -gain:
            chosen.append(g)
            left.difference_update(of.peptide[g])
        elif now and g - now * total <= last:
            heapq.heappush(heap, (-now, g))
    return pd.DataFrame({"id": chosen}, dtype="int64")


def _ranked(groups: DataFrame) -> DataFrame:
    """``groups`` with ``id``: numbers from 0 by score, highest first, then name."""
    order = (-F.col("score")).asc(), F.asc("first")
    rows = groups.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a partition
    return rows.join(F.broadcast(starts), "part").select(*groups.columns, (F.col("start") + F.col("at") - F.shiftleft("part", 33)).alias("id"))


def _rivals(rows: DataFrame, key: str) -> Column:
    """The first key among a peptide's other groups."""
    order = Window.partitionBy("peptide").orderBy(key)
    return F.when(F.row_number().over(order) == 1, F.lead(key).over(order)).otherwise(F.min(key).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _pairs(state: DataFrame) -> DataFrame:
    return state.select("id", "own", F.explode("peptides").alias("peptide"))


def _without(state: DataFrame, covered: DataFrame) -> DataFrame:
    """(id, own, peptides) without peptides that are covered."""
    return _pairs(state).join(covered, "peptide", "left_anti").groupBy("id", "own").agg(F.collect_list("peptide").alias("peptides"))


def _left(state: DataFrame) -> int:
    return state.agg(F.coalesce(F.sum(F.size("peptides")), F.lit(0))).first()[0]


def _in_one(state: DataFrame, total: int, last: int) -> DataFrame:
    """One task covers the few pairs that are left, up to the key ``last``."""

    def cover(rows: pd.DataFrame) -> pd.DataFrame:
        return _cover(rows, total, last)

    return _pairs(state).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(cover, "id long")


def _firsts(state: DataFrame, n: int, local: int, total: int) -> list[DataFrame]:
    """Picks among (id, own, peptides) of ``n`` pairs, some groups after the other.

    A key is a gain and an id, and only rises, as gains only fall; so groups beyond a key never come before those up to it. The
    first ``AHEAD`` of the groups go among themselves: in each round those that come before all that share a peptide with them are
    picked, and those whose key has risen beyond the last leave. Only when none are left all others lose the peptides that are covered.
    """
    picked, gain, groups = [], F.col("own") + F.size("peptides"), F.lit(total).cast("long")
    key = F.col("id") - gain * groups
    while n > local:
        last = int(state.select(key.cast("double").alias("key")).approxQuantile("key", [AHEAD], 0.01)[0])
        active, chosen = materialise(state.where(key <= last)), []
        m = _left(active)
        while m > local:
            keyed = active.select(key.alias("key"), "own", F.explode("peptides").alias("peptide"))
            first = keyed.groupBy("peptide").agg(F.min(F.struct("key", "own")).alias("of")).groupBy("of").agg(F.collect_list("peptide").alias("peptides"))
            ahead = first.select(F.pmod("of.key", groups).alias("id"), "of.key", "of.own", "peptides").where(F.col("key") == key)
            now = materialise(ahead.select("id", "peptides"))
            chosen.append(now.select("id"))
            active = materialise(_without(active, now.select(F.explode("peptides").alias("peptide"))).where(key <= last))
            m = _left(active)
        if m:
            chosen.append(_in_one(active, total, last))
        now = materialise(reduce(lambda a, b: a.unionByName(b), chosen))
        picked.append(now)
        state = materialise(_without(state, _pairs(state.join(now, "id", "left_semi")).select("peptide").distinct()))
        n, unsure = state.agg(F.coalesce(F.sum(F.size("peptides")), F.lit(0)), F.count_if(F.col("own") == 0)).first()
        if not unsure:
            return picked
    return [*picked, _in_one(state, total, total)]


def parsimonious(groups: DataFrame, local: int = LOCAL) -> DataFrame:
    """Groups that a greedy cover picks: most uncovered peptides, then score, then name.

    Rounds narrow down what a group's gain may be when its turn comes. At most it is
    ``most``, its peptides that no other is sure to take before. At least it is ``least``, the largest k
    for which k of its peptides have no other group that might come before this one at a gain of k.
    A group that comes first even at its least takes a peptide from a group that comes later even at its most: the pair
    is dropped, as the later group is never picked before. Peptides of one group alone are only counted (``own``).
    A group with a least gain is picked, one without peptides never is, and the rounds end when all groups are
    one or the other. Once they drop few pairs, groups are picked from the first keys on, those that come before all they
    share a peptide with in one round (``_firsts``). Once no more than ``local`` pairs of group and peptide are left, one task picks the rest.
    """
    groups = _ranked(materialise(groups))
    total = max(groups.count(), 1)
    each = groups.select("id", F.explode("peptides").alias("name"))
    names = materialise(each.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("peptide", F.monotonically_increasing_id()))
    each = each.join(names, "name")
    # A key is a gain and an id: lower ones come first, and no two groups have the same at any gains.
    key = lambda gain: F.col("id") - F.col(gain) * F.lit(total).cast("long")
    need = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.lit(1 << 30)).cast("int")
    pairs, picked = each.select("id", F.when(F.col("n") > 1, F.col("peptide")).alias("peptide"), need.alias("need"), F.lit(0).alias("own"), F.lit(0).alias("least")), []
    last, rounds = None, 0
    while True:
        by = pairs.groupBy("id").agg((F.max("own") + F.count_if(F.col("need") == 0)).cast("int").alias("own"), F.max("least").alias("before"), F.count(F.lit(1)).alias("n"), F.max("own").alias("had"), F.sort_array(F.collect_list("need")).alias("needs"), F.collect_list(F.when(F.col("need") > 0, F.col("peptide"))).alias("peptides"))
        enough = F.transform("needs", lambda x, i: F.when(x <= i + 1 + F.col("had"), i + 1 + F.col("had")).otherwise(0))
        state = materialise(by.select("id", "own", "before", (F.col("had") + F.col("n")).cast("int").alias("most"), F.greatest(F.col("own"), F.array_max(enough)).cast("int").alias("least"), "peptides"))
        picked.append(state.where("least > 0 and before = 0").select("id"))
        n, unsure = state.agg(F.coalesce(F.sum(F.size("peptides")), F.lit(0)), F.count_if(F.col("least") == 0)).first()
        if not unsure:
            break
        if n <= local or 2 * unsure > total or rounds and n > KEEP * last:  # bounds come from groups that are sure of a gain
            picked += _firsts(state.where(F.size("peptides") > 0).select("id", "own", "peptides"), n, local, total)
            break
        last, rounds = n, rounds + 1
        left = state.select("id", "own", "least", "most", F.explode("peptides").alias("peptide"))
        keyed = left.withColumns({"low": key("least"), "high": key("most")})
        kept = keyed.withColumn("taker", _rivals(keyed, "low")).where(F.col("taker").isNull() | (F.col("taker") > F.col("high"))).drop("taker", "low", "most")
        rival = kept.withColumn("rival", _rivals(kept, "high"))
        pairs = rival.select("id", "peptide", F.coalesce(F.floor((F.col("id") - F.col("rival")) / total) + 1, F.lit(0)).cast("int").alias("need"), "own", "least")
    every = reduce(lambda a, b: a.unionByName(b), picked)
    return groups.join(every, "id", "left_semi").drop("id")


def _holders(groups: DataFrame) -> DataFrame:
    """Each peptide once, with how many groups hold it (``n``) and the first of them by score, then leader."""
    each = groups.select("leader", (-F.col("score")).alias("s"), F.explode("peptides").alias("peptide"))
    held = each.groupBy("peptide").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s", "leader"))["leader"].alias("leader"))
    return materialise(held)


def _razor(groups: DataFrame, held: DataFrame) -> DataFrame:
    """``razor`` from ``_holders``: where no group of a peptide has a unique one, the first by score holds it; so only peptides of groups that have meet again."""
    unique = materialise(held.where("n = 1").groupBy("leader").agg(F.count(F.lit(1)).alias("n_unique")))
    strong = groups.join(unique, "leader").select("leader", (-F.col("n_unique")).alias("u"), (-F.col("score")).alias("s"), F.explode("peptides").alias("peptide"))
    first = strong.groupBy("peptide").agg(F.min(F.struct("u", "s", "leader"))["leader"].alias("strong"))
    return held.where("n > 1").join(first, "peptide", "left").select("peptide", F.coalesce("strong", "leader").alias("leader"))


def razor(groups: DataFrame) -> DataFrame:
    """(peptide, leader) of peptides in several groups: most unique peptides, then score, then leader."""
    return _razor(groups, _holders(groups))


def build_groups(groups: DataFrame) -> DataFrame:
    """leader, members, peptides, unique and razor peptides, score, is_decoy (all members are)."""
    named = materialise(groups.select(F.element_at("members", 1).alias("leader"), "members", "peptides", "score", F.forall("members", is_decoy).alias("is_decoy")))
    held = _holders(named)
    own = held.where("n = 1").select("peptide", "leader", F.lit(True).alias("alone")).unionByName(_razor(named, held).withColumn("alone", F.lit(False)))
    listed = lambda alone: F.sort_array(F.collect_list(F.when(F.col("alone") == alone, F.col("peptide"))))
    own = own.groupBy("leader").agg(listed(True).alias("unique_peptides"), listed(False).alias("razor_peptides"))
    none = F.array().cast("array<string>")
    return named.join(own, "leader", "left").withColumns({c: F.coalesce(c, none) for c in ("unique_peptides", "razor_peptides")})


def in_order(groups: DataFrame) -> DataFrame:
    """``groups`` sorted as reports show them: by score, highest first, then leader."""
    return groups.orderBy(F.desc("score"), "leader")


def coverage(groups: DataFrame, proteins: DataFrame) -> DataFrame:
    """(leader, coverage): share of the leader's residues under its peptides, I as L; null without a sequence."""
    own = groups.select("leader", F.array_distinct(F.concat("peptides", "razor_peptides")).alias("peptides"))
    found = occurrences.coverage(own.join(proteins.select(F.col("accession").alias("leader"), "sequence"), "leader"), "leader")
    return groups.select("leader").join(found, "leader", "left").select("leader", F.when(F.col("length") > 0, F.col("covered") / F.col("length")).alias("coverage"))


def infer(psms: DataFrame, proteins: DataFrame | None = None, q_threshold: float | None = 0.01) -> DataFrame:
    """The whole inference over matches (peptide, accessions, score, q_value)."""
    groups = build_groups(parsimonious(without_subsets(materialise(indistinguishable(hits(psms, q_threshold))))))
    if proteins is not None:
        groups = groups.join(coverage(groups, proteins), "leader")
    return groups
