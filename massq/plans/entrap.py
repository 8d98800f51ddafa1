"""Queries on entrapment analysis, text parsing, diagnostics.

Brands of ``part`` stand for accessions; conversation texts stand for trap proteins,
benchmark texts for targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massq.functions import exprs as X
from massq.operators import advice
from massq.operators import digest as D
from massq.operators import entrapment as E
from massq.operators.joins import hamming_join, similar_join
from massq.plans.matching import table
from massq.plans.proteins import _STD, _TRYPSIN, _mass, sequences
from massq.sources import results as R

CONFIG = E.Config(E.Rule(contains=("Brand#1",), ids=("PROMO",)), E.Rule(regex="[37]$"), "mark_ambiguous", "trap")


def tagging(spark, d):
    ids = F.concat(F.col("p_brand"), F.lit("; "), F.col("p_type"))
    return table(spark, d, "part").select(E.group_of(ids, CONFIG).alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def tagging_policies(spark, d):
    p = table(spark, d, "part")
    out = None
    for conflict in ("prefer_target", "prefer_trap"):
        c = E.Config(E.Rule(contains=("Brand#1",)), E.Rule(regex="[37]$"), conflict, "ignore")
        rows = p.groupBy(E.group_of(F.col("p_brand"), c).alias("group")).agg(F.count(F.lit(1)).alias("n")).withColumn("policy", F.lit(conflict))
        out = rows if out is None else out.unionByName(rows)
    return out


def tagging_sets(spark, d):
    """Accession sets too large for a list: types of large parts are targets, of small ones traps."""
    p = table(spark, d, "part")
    sets = p.where("p_size > 48").select(F.col("p_name").alias("accession"), F.lit("target").alias("kind")).union(p.where("p_size < 3").select("p_name", F.lit("trap"))).distinct()
    rows = p.select("p_partkey", F.concat("p_name", F.lit("; "), "p_type").alias("protein_ids"))
    return E.tag_by_sets(rows, sets).groupBy("in_target", "in_trap").agg(F.count(F.lit(1)).alias("n"))


def _words(spark, d, name: str, key: str) -> DataFrame:
    """Words as short peptides."""
    text = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", ""))
    w = table(spark, d, name).select(F.explode(F.split(text, " ")).alias("peptide"), F.col(key).cast("string").alias("protein"))
    return w.where("peptide <> ''")


def exact_and_folded(spark, d):
    """Words of conversations that are target words, or are but for I and L."""
    targets = _words(spark, d, "benchmark", "item_id").groupBy("peptide").agg(F.min("protein").alias("protein")).withColumn("folded", X.fold_il(F.col("peptide")))
    traps = _words(spark, d, "conversations", "conv_id").select("peptide").distinct().withColumn("folded", X.fold_il(F.col("peptide")))
    folded = targets.groupBy("folded").agg(F.min(F.struct("peptide", "protein")).alias("m"))
    rows = traps.join(targets.select("peptide", F.col("protein").alias("exact")), "peptide", "left").join(folded, "folded", "left")
    level = F.when(F.col("exact").isNotNull(), "L0").when(F.col("m").isNotNull(), "L1").otherwise("L4")
    return rows.select("peptide", level.alias("level"), F.coalesce(F.when(F.col("exact").isNotNull(), F.col("peptide")), F.col("m.peptide")).alias("best_target"))


def similar_words(spark, d):
    """Conversation words within two edits of a target word, the best distance and the first such word."""
    targets = _words(spark, d, "benchmark", "item_id").select("peptide")
    traps = _words(spark, d, "conversations", "conv_id").select("peptide")
    found = similar_join(traps, targets, "peptide", "peptide", 2)
    return found.groupBy("peptide").agg(F.min(F.struct("distance", "peptide_similar")).alias("m")).select("peptide", "m.distance", F.col("m.peptide_similar").alias("best"))


def hamming_words(spark, d):
    """Conversation words within two mismatches of a target word of their length, the fewest and the first such word."""
    targets = _words(spark, d, "benchmark", "item_id").select("peptide")
    traps = _words(spark, d, "conversations", "conv_id").select("peptide")
    found = hamming_join(traps, targets, "peptide", "peptide", 2)
    return found.groupBy("peptide").agg(F.min(F.struct("mismatches", "peptide_similar")).alias("m")).select("peptide", "m.mismatches", F.col("m.peptide_similar").alias("best"))


def classify_levels(spark, d):
    """The whole classification of conversation peptides against benchmark peptides."""
    index = E.target_index(sequences(spark, d, "benchmark", "item_id"), E.Config(E.Rule(regex="^t"), E.Rule(regex="^c")))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("sequence"))
    psms = D.digest(c, missed=0, shortest=6, keep=("conv_id", "turn")).select("peptide", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("protein_ids"))
    found = E.classify(psms, index, E.Config(E.Rule(regex="^t"), E.Rule(regex="^c")))
    return found.groupBy("group", "level", "substitution").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("peptides"), F.round(F.avg("delta_mass"), 4).alias("mean_delta"))


def classified(spark, d) -> DataFrame:
    """part as classified matches: level by size, mass change by price."""
    level = F.concat(F.lit("L"), (F.col("p_size") % 5).cast("string"))
    family = F.concat(F.lit("sp|P"), F.col("p_partkey").cast("string"), F.lit("|"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("_HUMAN;second"))
    return table(spark, d, "part").select(F.col("p_name").alias("peptide"), family.alias("protein_ids"), E.group_of(F.col("p_brand"), CONFIG).alias("group"), level.alias("level"), F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice") - 1000).alias("delta_mass"))


def entrapment_statistics(spark, d):
    s = E.statistics(classified(spark, d))
    return s.select("group", "level", "n", "n_mass", *[F.round(c, 6).alias(c) for c in ("mass_min", "mass_max", "mass_mean")])


def top_families(spark, d):
    return E.top_families(classified(spark, d), 10)


def razor_error_rows(spark, d):
    from massq.sources.sinks import razor_errors

    rows = classified(spark, d).withColumn("best_target_protein", F.lit("t"))
    return razor_errors(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("peptides"))


def classified_table(spark, d):
    from massq.sources.sinks import classified_lines

    return classified_lines(classified(spark, d)).groupBy("group", "level").agg(F.count(F.lit(1)).alias("n"), F.count("q_value").alias("with_q"))


def accession_parts(spark, d):
    s = table(spark, d, "supplier")
    acc = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "sp|").otherwise("x|"), F.col("s_suppkey").cast("string"), F.lit("|"), F.replace("s_name", F.lit("#"), F.lit("_")))
    return s.select("s_suppkey", X.uniprot_id(acc).alias("id"), X.family_name(acc).alias("family"))


def ion_labels(spark, d):
    li = table(spark, d, "lineitem")
    label = F.concat(F.when(F.col("l_linestatus") == "F", "b").otherwise("y"), F.col("l_linenumber").cast("string"), F.when(F.col("l_tax") > 0, "+").otherwise("-"), F.col("l_quantity").cast("int").cast("string"))
    return li.select(X.ion_label(label).alias("i")).where("i is not null").groupBy("i.type", "i.number").agg(F.count(F.lit(1)).alias("n"), F.sum("i.charge").cast("long").alias("charges"))


def modified_sequences(spark, d):
    """Tags of a modified sequence with 1-based and 0-based positions and both mass tables."""
    m = F.concat(F.lit("_AC"), F.when(F.col("p_size") % 2 == 0, "(UniMod:4)").otherwise(""), F.upper(F.substring("p_name", 1, 2)), F.lit("(UniMod:"), F.element_at(F.array(*map(F.lit, (35, 259, 267, 999))), (F.col("p_partkey") % 4 + 1).cast("int")).cast("string"), F.lit(")K_"))
    rows = table(spark, d, "part").select("p_partkey", m.alias("m"))
    a, b = R.modifications(F.col("m")), R.modifications(F.col("m"), 0, R.ENTRAPMENT_UNIMOD)
    last = lambda c: F.element_at(c, -1)
    return rows.select("p_partkey", R.strip_modified(F.col("m")).alias("plain"), F.size(a).alias("n"), last(a)["pos"].alias("pos1"), last(b)["pos"].alias("pos0"), F.round(last(a)["mass"], 6).alias("mass1"), F.round(last(b)["mass"], 6).alias("mass0"))


def pfind_mods(spark, d):
    text = F.concat(F.col("p_size").cast("string"), F.lit(",Oxidation[M];"), (F.col("p_size") + 1).cast("string"), F.lit(",Unknown[K];"))
    rows = table(spark, d, "part").select(F.explode(R.pfind_modifications(text)).alias("m"))
    return rows.groupBy("m.name").agg(F.count(F.lit(1)).alias("n"), F.sum("m.pos").cast("long").alias("positions"), F.round(F.sum("m.mass"), 3).alias("mass"))


def escaping(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit("\t<a&b>;"), F.coalesce("text", F.lit(""))).alias("t"))
    return c.select("conv_id", "turn", F.length(X.sanitize_tsv(F.col("t"))).cast("long").alias("tsv_len"), F.md5(X.sanitize_tsv(F.col("t")).cast("binary")).alias("tsv"), F.md5(X.escape_html(F.col("t")).cast("binary")).alias("html"))


def alignment_places(spark, d):
    t = F.concat(F.lit("N"), F.col("p_size").cast("string"), F.lit("→D,ins:G@5,K"), F.col("p_partkey").cast("string"), F.lit("→R"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.alignment_positions(t).cast("array<string>"), ",").alias("positions"))


def isobaric_words(spark, d):
    """Words with a doubled G after which one N instead would leave the rest the same."""
    w = _words(spark, d, "benchmark", "item_id").select("peptide").distinct()
    pairs = w.select(F.replace("peptide", F.lit("N"), F.lit("GG")).alias("longer"), F.col("peptide").alias("shorter"))
    return pairs.select("shorter", X.isobaric_dipeptide(F.col("shorter"), F.col("longer")).alias("residue"))


def co_elution(spark, d):
    """Orders as peptides that elute for three weeks, customers as runs of four windows by price."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("double")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("run"), F.col("o_orderkey").cast("string").alias("peptide"), F.col("o_totalprice").alias("precursor_mz"), day.alias("rt_start"), (day + 21).alias("rt_stop"), "o_orderpriority")
    windows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("run")).distinct().select("run", F.explode(F.array(*[F.lit(x) for x in (75_000.0, 225_000.0, 375_000.0, 525_000.0)])).alias("target"), F.lit(75_000.0).alias("lower"), F.lit(75_000.0).alias("upper"))
    found = E.co_eluting(o.where("o_orderpriority like '1%'").drop("o_orderpriority"), o.drop("o_orderpriority"), windows, 3, 22.0)
    return found.select(F.col("t_id").alias("trap"), F.col("o_id").alias("other"), "rank")


def diagnostics(spark, d):
    """Anomalies of each event type taken for a run."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("psms"), F.count_if(F.col("value") < 0).alias("decoys"), F.avg((F.col("value") < 30).cast("double")).alias("id_rate"), F.min("value").alias("tolerance_ppm"), F.lit(8.0).alias("matching_sec"), F.lit(9.0).alias("total_sec"))
    return advice.diagnose(e).select("event_type", "anomaly", "priority")


def modification_union(spark, d):
    """Modifications of two parts of a pair merged by their full identity."""
    p = table(spark, d, "part").select("p_partkey", F.array(F.struct(F.lit("Oxidation").alias("name"), F.lit(15.994915).alias("delta")), F.struct(F.col("p_type").alias("name"), F.col("p_size").cast("double").alias("delta"))).alias("a"), F.array(F.struct(F.lit("Oxidation").alias("name"), F.lit(15.994915).alias("delta")), F.struct(F.lit("PROMO").alias("name"), F.lit(7.0).alias("delta"))).alias("b"))
    return p.groupBy(F.size(advice.merged(F.col("a"), F.col("b"))).cast("long").alias("mods")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (tagging, tagging_policies, tagging_sets, exact_and_folded, similar_words, hamming_words, classify_levels, entrapment_statistics, top_families, razor_error_rows, classified_table, accession_parts, ion_labels, modified_sequences, pfind_mods, escaping, alignment_places, isobaric_words, co_elution, diagnostics, modification_union)}

_TAG = "CASE WHEN (b LIKE '%Brand#1%' OR t = 'PROMO' OR t LIKE '%Brand#1%') AND (regexp_matches(b, '[37]$') OR regexp_matches(t, '[37]$')) THEN 'ambiguous' WHEN b LIKE '%Brand#1%' OR t = 'PROMO' OR t LIKE '%Brand#1%' THEN 'target' ELSE 'trap' END"
_CLS = "c AS (SELECT p_name AS peptide, 'sp|P' || p_partkey || '|' || upper(split_part(p_name, ' ', 2)) || '_HUMAN;second' AS ids, upper(split_part(p_name, ' ', 2)) AS family, CASE WHEN p_brand LIKE '%Brand#1%' AND regexp_matches(p_brand, '[37]$') THEN 'ambiguous' WHEN p_brand LIKE '%Brand#1%' THEN 'target' ELSE 'trap' END AS \"group\", 'L' || (p_size % 5) AS level, CASE WHEN p_size % 3 > 0 THEN p_retailprice - 1000 END AS dm FROM part)"
_WORDS = """bw AS (SELECT DISTINCT p AS peptide FROM (SELECT unnest(string_split(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')), ' ')) AS p FROM benchmark) WHERE p <> ''),
cw AS (SELECT DISTINCT p AS peptide FROM (SELECT unnest(string_split(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')), ' ')) AS p FROM conversations) WHERE p <> '')"""
_WINDOW = "(CASE WHEN o_totalprice BETWEEN 0 AND 150000 THEN 75000 WHEN o_totalprice <= 300000 THEN 225000 WHEN o_totalprice <= 450000 THEN 375000 WHEN o_totalprice <= 600000 THEN 525000 END)"
SQL = {
    "tagging": f"WITH p AS (SELECT p_brand AS b, p_type AS t FROM part) SELECT {_TAG} AS \"group\", count(*) AS n FROM p GROUP BY 1",
    "tagging_policies": """WITH p AS (SELECT p_brand LIKE '%Brand#1%' AS g, regexp_matches(p_brand, '[37]$') AS r FROM part) SELECT 'prefer_target' AS policy, CASE WHEN g THEN 'target' WHEN r THEN 'trap' ELSE 'target' END AS "group", count(*) AS n FROM p GROUP BY 2
UNION ALL SELECT 'prefer_trap', CASE WHEN r THEN 'trap' ELSE 'target' END, count(*) FROM p GROUP BY 2""",
    "tagging_sets": "WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size > 48), b AS (SELECT DISTINCT p_name FROM part WHERE p_size < 3) SELECT p_name IN (SELECT p_name FROM a) AS in_target, p_name IN (SELECT p_name FROM b) AS in_trap, count(*) AS n FROM part GROUP BY 1, 2",
    "exact_and_folded": f"""WITH {_WORDS}, f AS (SELECT translate(peptide, 'I', 'L') AS f, min(peptide) AS peptide FROM bw GROUP BY 1)
SELECT cw.peptide, CASE WHEN bw.peptide IS NOT NULL THEN 'L0' WHEN f.peptide IS NOT NULL THEN 'L1' ELSE 'L4' END AS level, coalesce(bw.peptide, f.peptide) AS best_target FROM cw LEFT JOIN bw ON bw.peptide = cw.peptide LEFT JOIN f ON f.f = translate(cw.peptide, 'I', 'L')""",
    "similar_words": f"""WITH {_WORDS}, l AS (SELECT a.peptide, b.peptide AS t, levenshtein(a.peptide, b.peptide)::INT AS distance FROM cw a JOIN bw b ON abs(len(a.peptide) - len(b.peptide)) <= 2 AND a.peptide <> b.peptide)
SELECT peptide, min(distance) AS distance, arg_min(t, struct_pack(d := distance, t := t)) AS best FROM l WHERE distance <= 2 GROUP BY 1""",
    "hamming_words": f"""WITH {_WORDS}, l AS (SELECT a.peptide, b.peptide AS t, hamming(a.peptide, b.peptide)::INT AS mismatches FROM cw a JOIN bw b ON len(a.peptide) = len(b.peptide) AND a.peptide <> b.peptide)
SELECT peptide, min(mismatches) AS mismatches, arg_min(t, struct_pack(d := mismatches, t := t)) AS best FROM l WHERE mismatches <= 2 GROUP BY 1""",
    "entrapment_statistics": f"WITH {_CLS} SELECT \"group\", level, count(*) AS n, count(dm) AS n_mass, round(min(dm), 6) AS mass_min, round(max(dm), 6) AS mass_max, round(avg(dm), 6) AS mass_mean FROM c GROUP BY 1, 2",
    "top_families": f"WITH {_CLS} SELECT family, count(*) AS n, min(peptide) AS example FROM c WHERE \"group\" = 'trap' AND level = 'L0' GROUP BY 1 ORDER BY n DESC, family LIMIT 10",
    "razor_error_rows": f"WITH {_CLS} SELECT 'exact target peptide assigned to a trap protein' AS reason, count(*) AS n, count(DISTINCT peptide) AS peptides FROM c WHERE \"group\" = 'trap' AND level = 'L0'",
    "classified_table": f"WITH {_CLS} SELECT \"group\", level, count(*) AS n, 0::BIGINT AS with_q FROM c GROUP BY 1, 2",
    "accession_parts": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR END AS id, 'Supplier' AS family FROM supplier",
    "ion_labels": "SELECT CASE WHEN l_linestatus = 'F' THEN 'b' ELSE 'y' END AS type, l_linenumber AS number, count(*) AS n, sum(l_quantity::INT)::BIGINT AS charges FROM lineitem WHERE l_tax > 0 GROUP BY 1, 2",
    "modified_sequences": """WITH m AS (SELECT p_partkey, p_size % 2 = 0 AS two, upper(p_name[1:2]) AS u, [35, 259, 267, 999][p_partkey % 4 + 1] AS id FROM part)
SELECT p_partkey, 'AC' || u || 'K' AS plain, CASE WHEN two THEN 2 ELSE 1 END::INT AS n, 4::INT AS pos1, 3::INT AS pos0, CASE id WHEN 35 THEN 15.994915 WHEN 259 THEN 10.008269 WHEN 267 THEN 7.017165 ELSE 0 END::DOUBLE AS mass1, CASE id WHEN 35 THEN 15.994915 WHEN 259 THEN 8.014199 WHEN 267 THEN 10.008269 ELSE 0 END::DOUBLE AS mass0 FROM m""",
    "pfind_mods": "SELECT 'Oxidation' AS name, count(*) AS n, sum(p_size)::BIGINT AS positions, round(count(*) * 15.994915::DOUBLE, 3) AS mass FROM part UNION ALL SELECT 'Unknown', count(*), sum(p_size + 1)::BIGINT, 0.0 FROM part",
    "escaping": """WITH c AS (SELECT conv_id, turn, role || chr(9) || '<a&b>;' || coalesce(text, '') AS t FROM conversations), s AS (SELECT *, translate(t, chr(9) || chr(10) || chr(13) || ';', '    ') AS v FROM c)
SELECT conv_id, turn, len(v)::BIGINT AS tsv_len, md5(v) AS tsv, md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html FROM s""",
    "alignment_places": "SELECT p_partkey, p_size || ',' || p_partkey AS positions FROM part",
    "isobaric_words": f"WITH {_WORDS} SELECT peptide AS shorter, CASE WHEN len(peptide) - len(replace(peptide, 'N', '')) = 1 THEN 'N' END AS residue FROM bw",
    "co_elution": f"""WITH o AS (SELECT *, {_WINDOW} AS w, o_orderdate::DATE AS a FROM orders), p AS (SELECT t.o_orderkey AS trap, x.o_orderkey AS other, x.a FROM o t JOIN o x ON t.o_custkey = x.o_custkey AND t.w = x.w AND t.o_orderkey <> x.o_orderkey AND abs(t.a - x.a) <= 21 WHERE t.o_orderpriority LIKE '1%')
SELECT trap, other, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY trap ORDER BY a, other) AS r FROM p) WHERE r <= 3""",
    "diagnostics": """WITH s AS (SELECT event_type, count(*) AS psms, count(*) FILTER (value < 0) AS decoys, avg((value < 30)::INT) AS id_rate, min(value) AS tol FROM events GROUP BY 1)
SELECT event_type, 'NoDecoyHits' AS anomaly, 1::INT AS priority FROM s WHERE decoys = 0 UNION ALL SELECT event_type, 'VeryLowIdRate', 2 FROM s WHERE id_rate < 0.05 UNION ALL SELECT event_type, 'LowIdRate', 3 FROM s WHERE id_rate >= 0.05 AND id_rate < 0.10
UNION ALL SELECT event_type, 'NoPsms', 1 FROM s WHERE psms = 0 UNION ALL SELECT event_type, 'FewPsms', 3 FROM s WHERE psms > 0 AND psms < 50 UNION ALL SELECT event_type, 'ToleranceTooTight', 4 FROM s WHERE tol < 5 AND id_rate < 0.10 UNION ALL SELECT event_type, 'ToleranceTooWide', 4 FROM s WHERE tol > 50""",
    "modification_union": "SELECT CASE WHEN p_type = 'PROMO' AND p_size = 7 THEN 2 ELSE 3 END::BIGINT AS mods, count(*) AS n FROM part GROUP BY 1",
}

_FITS = f"len(p) BETWEEN 6 AND 50 AND regexp_full_match(p, '{_STD}')"
_CLASSES = f"""seq AS (SELECT upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s, 'b' AS src FROM benchmark UNION ALL SELECT upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'c' FROM conversations),
f AS (SELECT src, {_TRYPSIN} AS f FROM seq), fm AS (SELECT f, unnest(range(0, least(3, len(f)))) AS m FROM f WHERE src = 'b'), fi AS (SELECT f, m, unnest(range(1, len(f) - m + 1)) AS i FROM fm),
tg AS (SELECT DISTINCT p AS t, translate(p, 'I', 'L') AS fold, {_mass("p")} AS mass FROM (SELECT array_to_string(f[i:i + m], '') AS p FROM fi) WHERE {_FITS}),
ps AS (SELECT p FROM (SELECT unnest(f) AS p FROM f WHERE src = 'c') WHERE {_FITS}), pp AS (SELECT DISTINCT p, translate(p, 'I', 'L') AS fold, {_mass("p")} AS mass FROM ps),
nr AS (SELECT p, t, CASE WHEN len(p) = len(t) THEN len(list_filter(range(1, len(p) + 1), lambda i: p[i] <> t[i])) ELSE levenshtein(p, t) END AS e, len(p) <> len(t) AS cr, round(tg.mass - pp.mass, 9) AS dm, CASE WHEN len(p) < len(t) THEN p ELSE t END AS sh, CASE WHEN len(p) < len(t) THEN t ELSE p END AS lo
FROM pp JOIN tg ON abs(len(p) - len(t)) <= 2 AND p <> t AND pp.fold <> tg.fold AND levenshtein(p, t) <= 2),
kd AS (SELECT *, CASE WHEN NOT cr AND e = 1 AND list_contains(list_transform(range(1, len(p) + 1), lambda i: p[i] || t[i]), 'QK') OR NOT cr AND e = 1 AND list_contains(list_transform(range(1, len(p) + 1), lambda i: p[i] || t[i]), 'KQ') THEN 'qk'
WHEN len(lo) = len(sh) + 1 AND len(list_filter(range(1, len(sh) + 1), lambda i: sh[1:i - 1] = lo[1:i - 1] AND sh[i + 1:] = lo[i + 2:] AND (sh[i] = 'N' AND lo[i:i + 1] = 'GG' OR sh[i] = 'Q' AND lo[i:i + 1] IN ('AG', 'GA')))) > 0 THEN 'isobaric_dipeptide' WHEN abs(dm) < 1 THEN 'near_isobaric' ELSE 'distinguishable' END AS kind FROM nr WHERE e <= 2),
bt AS (SELECT p, min(struct_pack(e := e, a := abs(dm), cr := cr, t := t, dm := dm, kind := kind)) AS b FROM kd GROUP BY 1),
lv AS (SELECT pp.p, CASE WHEN pp.p IN (SELECT t FROM tg) THEN 'L0' WHEN fold IN (SELECT fold FROM tg) THEN 'L1' WHEN b.a < 1 THEN 'L2' WHEN b IS NOT NULL THEN 'L3' ELSE 'L4' END AS level, b FROM pp LEFT JOIN bt ON bt.p = pp.p)"""
SQL["classify_levels"] = f"""WITH {_CLASSES} SELECT 'trap' AS "group", level, CASE WHEN level IN ('L2', 'L3') THEN b.kind END AS substitution, count(*) AS n, count(DISTINCT ps.p) AS peptides, round(avg(CASE WHEN level IN ('L2', 'L3') THEN b.dm WHEN level IN ('L0', 'L1') THEN 0 END), 4) AS mean_delta FROM ps JOIN lv ON lv.p = ps.p GROUP BY 1, 2, 3"""
#: The tool's query (``files.tool_similar``) asks for one peptide of benchmark with another first letter.
_ONE = _CLASSES.replace("ps AS (SELECT p FROM (SELECT unnest(f) AS p FROM f WHERE src = 'c') WHERE", "ps AS (SELECT 'W' || min(p)[2:] AS p FROM (SELECT unnest(f) AS p FROM f WHERE src = 'b') WHERE len(p) >= 7 AND")
SQL["tool_similar"] = f"""WITH {_ONE} SELECT p AS peptide, level, CASE level WHEN 'L0' THEN p WHEN 'L1' THEN (SELECT min(t) FROM tg WHERE tg.fold = translate(lv.p, 'I', 'L')) ELSE b.t END AS best_target FROM lv"""
