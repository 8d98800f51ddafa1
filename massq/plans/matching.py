"""Queries on joins, ranking, q-values and roll-ups.

The tables stand in for search results: ``lineitem`` rows are matches (price the score, R
returns the decoys, part the peptide, supplier the protein), ``part`` rows candidates,
``events`` scans. Queries read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massq.functions import exprs as X
from massq.operators import fdr, joins, search, spectra
from massq.operators.shared import materialise, shared_path
from massq.sources.sinks import load_history, write_json


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("is_decoy", F.col("l_returnflag") == "R")


def psms(spark, d: str) -> DataFrame:
    """lineitem as matches: q-values are discounts, none where there is no tax."""
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return table(spark, d, "lineitem").select(p.alias("peptide"), s.alias("accession"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("q_value"), (F.col("l_tax") * 100 - 4).alias("delta_ppm"), F.col("l_linenumber").alias("charge"))


_PSMS = """p AS (SELECT l_partkey::VARCHAR AS peptide, l_suppkey::VARCHAR AS accession, l_extendedprice AS score, CASE WHEN l_tax > 0 THEN l_discount END AS q_value, l_tax * 100 - 4 AS delta_ppm, l_linenumber AS charge FROM lineitem)"""


def q_value(spark, d):
    return fdr.with_q(lines(spark, d), "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("q_value", 9).alias("q_value"))


def q_sql(rows: str) -> str:
    """CTEs from ``rows(score, is_decoy)`` to ``q(score, q_value)``."""
    return f"""s AS (SELECT score, count(*) FILTER (NOT is_decoy) AS t, count(*) FILTER (is_decoy) AS d FROM {rows} GROUP BY score),
c AS (SELECT score, sum(t) OVER w AS t, sum(d) OVER w AS d FROM s WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT score, CASE WHEN t > 0 THEN least(1.0::DOUBLE, d::DOUBLE / t) ELSE 1.0::DOUBLE END AS fdr FROM c),
q AS (SELECT score, min(fdr) OVER (ORDER BY score) AS q_value FROM f)"""


def peptide_q_value(spark, d):
    rows = lines(spark, d).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return fdr.with_q(fdr.best_per(rows, "l_partkey", "l_extendedprice", order="o"), "l_extendedprice").select("l_partkey", F.col("l_extendedprice").alias("score"), "is_decoy", F.round("q_value", 9).alias("q_value"))


def picked_protein_q(spark, d):
    """Users as proteins: errors are their decoys' scores, all other events their own."""
    e = table(spark, d, "events")
    name = F.concat(F.when(F.col("event_type") == "error", "REV_").otherwise(""), F.lit("u"), F.col("user_id").cast("string"))
    return fdr.picked_q(e.groupBy(name.alias("leader")).agg(F.max("value").alias("score"))).select("leader", "score", F.round("q_value", 9).alias("q_value"))


def unit_prices(spark, d):
    return lines(spark, d).withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))


def band_join_ppm(spark, d):
    return joins.ppm_join(unit_prices(spark, d), table(spark, d, "part"), "unit", "p_retailprice", 20).select("l_orderkey", "l_linenumber", "p_partkey", F.round(X.delta_ppm(F.col("unit"), F.col("p_retailprice")), 6).alias("delta_ppm"))


def band_join_da(spark, d):
    part = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 0.005).alias("lo"), (F.col("p_retailprice") + 0.005).alias("hi"))
    return joins.band_join(unit_prices(spark, d), part, "unit", "lo", "hi", 0.01).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


def scored_candidates(spark, d, ppm: float):
    """Lines with the first part at each price within ppm: parts of one price score alike, and the first of them would win."""
    first = table(spark, d, "part").groupBy("p_retailprice").agg(F.min("p_partkey").alias("p_partkey"))
    pairs = joins.ppm_join(unit_prices(spark, d), first, "unit", "p_retailprice", ppm)
    return pairs.withColumn("score", -F.abs(F.col("unit") - F.col("p_retailprice")) / F.col("p_retailprice"))


def best_match(spark, d):
    rows = scored_candidates(spark, d, 200).select("l_orderkey", "l_linenumber", "l_partkey", "p_partkey", "score")
    best = search.best_matches(rows, ("l_orderkey", "l_linenumber", "l_partkey"), ("p_partkey",))
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "p_partkey", F.round(-F.col("score") * 1e6, 4).alias("ppm"))


def target_decoy_search(spark, d):
    """Candidates by price, best match, q-value, and per line status what stays at 1 percent."""
    rows = scored_candidates(spark, d, 200).select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "is_decoy", "p_partkey", "score")
    best = search.best_matches(rows, ("l_orderkey", "l_linenumber", "l_partkey"), ("p_partkey",)).withColumn("score", F.round("score", 12))
    scored = fdr.with_q(materialise(best))
    good = (F.col("q_value") <= 0.01) & ~F.col("is_decoy")
    return scored.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("matches"), F.count_if(good).alias("at_1pct"), F.round(F.min("q_value"), 9).alias("least_q"), F.countDistinct("p_partkey").alias("candidates"))


def rt_asof(spark, d):
    o = table(spark, d, "orders").withColumn("rt", F.col("o_totalprice") / 1000)
    return joins.nearest_join(o, table(spark, d, "events"), (("o_custkey", "user_id"),), "rt", "value", 5.0, ["o_orderkey"], ["value", "event_id"]).select("o_orderkey", "event_id", F.round("distance", 6).alias("distance"))


def rt_asof_accept(spark, d):
    """Only scans whose window holds the value: here events of another type than errors."""
    o = table(spark, d, "orders").withColumn("rt", F.col("o_totalprice") / 1000)
    e = table(spark, d, "events")
    found = joins.nearest_join(o, e, (("o_custkey", "user_id"),), "rt", "value", 5.0, ["o_orderkey"], ["value", "event_id"], accept=F.col("event_type") != "error")
    return found.join(e.select("event_id", "event_type"), "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


def unmatched(spark, d):
    o = table(spark, d, "orders").withColumn("rt", F.col("o_totalprice") / 1000)
    hit = joins.nearest_join(o, table(spark, d, "events"), (("o_custkey", "user_id"),), "rt", "value", 5.0, ["o_orderkey"], ["event_id"])
    return o.join(hit, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("unmatched"))


def scans(spark, d):
    """events as scans: views are MS1; the others name a source scan that may not be one."""
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.when(F.col("event_type") != "view", (F.col("event_id") - k % 5).cast("int"))
    precursor = F.struct(F.col("value").alias("mz"), F.lit(2).alias("charge"), F.lit(None).cast("double").alias("intensity"), F.struct(F.col("value").alias("target"), (k / 10).alias("lower"), (k / 10).alias("upper")).alias("isolation"), source.alias("source_scan"))
    level = F.when(F.col("event_type") == "view", 1).otherwise(2)
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").cast("int").alias("scan"), level.alias("ms_level"), F.col("value").alias("rt_min"), F.array(precursor).alias("precursors"), F.array("value").alias("mz"), F.array(k.cast("double")).alias("intensity"), F.lit("centroid").alias("representation"))


def ms1_correlation(spark, d):
    return spectra.correlate(scans(spark, d))


def overlapping_intervals(spark, d):
    day = F.unix_date(F.to_date("o_orderdate")).cast("double")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", day.alias("a"), (day + 30).alias("b"))
    other = o.select(*[F.col(c).alias(f"r_{c}") for c in o.columns])
    return joins.overlap_join(o, other, (("o_custkey", "r_o_custkey"),), ("a", "b"), ("r_a", "r_b"), 31.0).where("o_orderkey < r_o_orderkey").select("o_orderkey", F.col("r_o_orderkey").alias("other"))


def similar_names(spark, d):
    p = table(spark, d, "part")
    return joins.similar_join(p, p, "p_name", "p_name", 2, keys=(("p_brand", "p_brand"),)).where("p_name < p_name_similar")


def hamming_names(spark, d):
    """Names of one length with at most four mismatches, and what differs."""
    names = table(spark, d, "part").select(F.upper("p_name").alias("a")).distinct()
    pairs = joins.hamming_join(names, names, "a", "a", 4).where("a < a_similar").withColumnRenamed("a_similar", "b").drop("mismatches")
    diffs = X.differences(F.col("a"), F.col("b"))
    rows = pairs.withColumn("x", diffs)
    return rows.select("a", "b", F.size("x").alias("mismatches"), X.difference_text(F.col("x")).alias("detail"), X.only_il(F.col("a"), F.col("b")).alias("only_il"), X.single_qk(F.col("x")).alias("single_qk"), F.round(X.substitution_mass(F.col("x")), 6).alias("delta_mass"))


def peptide_rollup(spark, d):
    r = search.peptide_rollup(psms(spark, d))
    return r.select("peptide", "best_score", "q_value", F.array_join("accessions", ";").alias("accessions"), "psm_count")


def protein_rollup(spark, d):
    return search.protein_rollup(psms(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def summary_filtered(spark, d):
    return _rounded(search.summary(psms(spark, d)))


def summary_all(spark, d):
    return _rounded(search.summary(psms(spark, d), filtered=False))


def charge_histogram(spark, d):
    p = psms(spark, d)
    return p.where(X.passes_q(F.col("q_value"), 0.01)).groupBy("charge").agg(F.count(F.lit(1)).alias("n"))


def medians(spark, d):
    p = psms(spark, d)
    return p.groupBy("charge").agg(F.median("score").alias("mean_of_middle"), X.lower_median("score").alias("lower_middle"), X.upper_median("score").alias("upper_middle"))


def import_by_run(spark, d):
    """The import's summary for each run: nations are runs, and rows without a tax have no scan."""
    p = table(spark, d, "lineitem").join(table(spark, d, "nation"), F.col("l_suppkey") % 25 == F.col("n_nationkey"))
    rows = p.select(F.col("n_name").alias("run"), F.when(F.col("l_tax") > 0, F.col("l_orderkey")).alias("scan"), F.col("l_partkey").alias("peptide"), F.col("l_discount").alias("q_value"))
    return search.import_summary(rows, q=0.02, by=("run",)).drop("runs").withColumn("identification_rate", F.round("identification_rate", 9))


def q_null_passes(spark, d):
    return psms(spark, d).where(X.passes_q(F.col("q_value"), 0.02)).groupBy("charge").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q_value").isNull()).alias("without_q"))


def candidate_cap(spark, d):
    """At most 20 candidates a supplier, by price, then key."""
    found = search.capped(table(spark, d, "lineitem"), ("l_suppkey",), 20, (F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"))
    return found.select("l_suppkey", "rank", "l_extendedprice")


def history(spark, d):
    """orders as a history of runs, written and read again: the last 20 whose status starts with 1."""
    o, path = table(spark, d, "orders"), shared_path(spark)
    runs = o.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("run_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.col("o_orderpriority").alias("status"), F.lit("simple").alias("engine"), F.lit(0).cast("long").alias("psms"))
    write_json(runs, path)
    return load_history(spark, path, "1", 20).select(F.col("run_id").cast("long").alias("o_orderkey"), F.col("status").alias("o_orderpriority"))


def export_lines(spark, d):
    from massq.sources.sinks import psm_lines

    li = lines(spark, d).select(F.col("l_orderkey").alias("scan"), F.concat(F.lit("a\t;"), F.col("l_shipdate").cast("date").cast("string")).alias("peptide"), F.col("l_linenumber").alias("charge"), F.col("l_quantity").alias("precursor_mz"), F.col("l_discount").alias("calculated_mz"), F.col("l_tax").alias("delta_ppm"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("q_value"), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("accessions"), "is_decoy", F.array("l_linestatus").alias("modifications"))
    return psm_lines(li)


def score_histogram(spark, d):
    """Mass differences in bins of 10, as the report draws them."""
    return search.histogram(lines(spark, d), F.col("l_extendedprice") / F.col("l_quantity"), 10, 900)


QUERIES = {f.__name__: f for f in (q_value, peptide_q_value, picked_protein_q, band_join_ppm, band_join_da, best_match, target_decoy_search, rt_asof, rt_asof_accept, unmatched, ms1_correlation, overlapping_intervals, similar_names, hamming_names, peptide_rollup, protein_rollup, summary_filtered, summary_all, charge_histogram, medians, import_by_run, q_null_passes, candidate_cap, history, export_lines, score_histogram)}

_UNIT = "u AS (SELECT *, l_extendedprice / l_quantity AS unit FROM lineitem)"
_BEST = f"""{_UNIT}, m AS (SELECT u.*, p_partkey, -abs(unit - p_retailprice) / p_retailprice AS score FROM u JOIN part ON p_retailprice BETWEEN unit * 0.9997 AND unit * 1.0003 AND abs(unit - p_retailprice) / p_retailprice * 1e6 <= 200),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY score DESC, p_partkey) AS r FROM m) WHERE r = 1)"""
_SUMMARY = """SELECT count(*) AS psms, count(*) FILTER (good) AS psms_at_q, count(DISTINCT CASE WHEN good THEN peptide END) AS peptides_at_q, count(DISTINCT CASE WHEN good THEN accession END) AS proteins_at_q,
round(median(CASE WHEN {keep} THEN score END), 6) AS median_score, round(median(CASE WHEN {keep} THEN delta_ppm END), 6) AS median_delta_ppm FROM (SELECT *, coalesce(q_value <= 0.01, false) AS good FROM p)"""
_NEAR = "n AS (SELECT o_orderkey, o_orderstatus, event_id, event_type, value, abs(o_totalprice / 1000 - value) AS distance FROM orders JOIN events ON o_custkey = user_id AND abs(o_totalprice / 1000 - value) <= 5.0)"
SQL = {
    "q_value": f"WITH r AS (SELECT l_extendedprice AS score, l_returnflag = 'R' AS is_decoy FROM lineitem), {q_sql('r')} SELECT l_orderkey, l_linenumber, round(q_value, 9) AS q_value FROM lineitem JOIN q ON l_extendedprice = score",
    "peptide_q_value": f"""WITH b AS (SELECT l_partkey, l_extendedprice AS score, l_returnflag = 'R' AS is_decoy, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber, l_returnflag = 'R') AS r FROM lineitem),
r AS (SELECT * FROM b WHERE r = 1), {q_sql("r")} SELECT l_partkey, r.score, is_decoy, round(q_value, 9) AS q_value FROM r JOIN q ON r.score = q.score""",
    "picked_protein_q": f"""WITH g AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN NULL ELSE value END) AS t, max(CASE WHEN event_type = 'error' THEN value END) AS d FROM events GROUP BY 1),
r AS (SELECT 'u' || user_id AS leader, coalesce(t IS NULL OR d > t, false) AS is_decoy, CASE WHEN coalesce(t IS NULL OR d > t, false) THEN d ELSE t END AS score FROM g), {q_sql("r")}
SELECT leader, r.score, round(q_value, 9) AS q_value FROM r JOIN q ON r.score = q.score WHERE NOT is_decoy""",
    "band_join_ppm": f"WITH {_UNIT} SELECT l_orderkey, l_linenumber, p_partkey, round((unit - p_retailprice) / p_retailprice * 1e6, 6) AS delta_ppm FROM u JOIN part ON p_retailprice BETWEEN unit * 0.9999 AND unit * 1.0001 AND abs(unit - p_retailprice) / p_retailprice * 1e6 <= 20",
    "band_join_da": f"WITH {_UNIT} SELECT p_partkey, count(*) AS n FROM u JOIN part ON unit BETWEEN p_retailprice - 0.005 AND p_retailprice + 0.005 GROUP BY 1",
    "best_match": f"WITH {_BEST} SELECT l_orderkey, l_linenumber, l_partkey, p_partkey, round(-score * 1e6, 4) AS ppm FROM b",
    "target_decoy_search": f"""WITH {_BEST}, r AS (SELECT l_linestatus, p_partkey, l_returnflag = 'R' AS is_decoy, round(score, 12) AS score FROM b), {q_sql("r")}
SELECT l_linestatus, count(*) AS matches, count(*) FILTER (q_value <= 0.01 AND NOT is_decoy) AS at_1pct, round(min(q_value), 9) AS least_q, count(DISTINCT p_partkey) AS candidates FROM r JOIN q ON r.score = q.score GROUP BY 1""",
    "rt_asof": f"WITH {_NEAR} SELECT o_orderkey, event_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY distance, value, event_id) AS r FROM n) WHERE r = 1",
    "rt_asof_accept": f"WITH {_NEAR} SELECT event_type, count(*) AS n, round(avg(distance), 6) AS mean_distance FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY distance, value, event_id) AS r FROM n WHERE event_type <> 'error') WHERE r = 1 GROUP BY 1",
    "unmatched": f"WITH {_NEAR} SELECT o_orderstatus, count(*) AS unmatched FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) GROUP BY 1",
    "ms1_correlation": """WITH e AS (SELECT user_id::VARCHAR AS run, event_id::INT AS scan, event_type = 'view' AS ms1, value, (event_id - (props->>'$.k')::INT % 5)::INT AS source FROM events),
w AS (SELECT *, max(CASE WHEN ms1 THEN scan END) OVER (PARTITION BY run ORDER BY scan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
f AS (SELECT run, arg_min(scan, value) AS first FROM e WHERE ms1 GROUP BY 1)
SELECT w.run, w.scan, CASE WHEN k.scan IS NOT NULL THEN w.source ELSE coalesce(before, first) END AS ms1_scan,
CASE WHEN k.scan IS NOT NULL THEN 'source_scan' WHEN before IS NOT NULL THEN 'scan_order' WHEN first IS NOT NULL THEN 'nearest_rt' END AS method
FROM w LEFT JOIN e k ON k.ms1 AND k.run = w.run AND k.scan = w.source LEFT JOIN f ON f.run = w.run WHERE NOT w.ms1""",
    "overlapping_intervals": "SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_orderdate::DATE - b.o_orderdate::DATE) <= 30",
    "similar_names": """WITH n AS (SELECT DISTINCT p_brand, p_name FROM part)
SELECT a.p_brand, a.p_name, b.p_name AS p_name_similar, levenshtein(a.p_name, b.p_name)::INT AS distance FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE abs(len(a.p_name) - len(b.p_name)) <= 2 AND levenshtein(a.p_name, b.p_name) <= 2""",
    "peptide_rollup": f"WITH {_PSMS} SELECT peptide, max(score) AS best_score, min(q_value) AS q_value, array_to_string(list_sort(list(DISTINCT accession)), ';') AS accessions, count(*) AS psm_count FROM p GROUP BY 1",
    "protein_rollup": f"WITH {_PSMS}, o AS (SELECT peptide, count(DISTINCT accession) AS n FROM p GROUP BY 1) SELECT accession, count(DISTINCT p.peptide) AS peptide_count, count(DISTINCT CASE WHEN n = 1 THEN p.peptide END) AS unique_peptide_count FROM p JOIN o USING (peptide) GROUP BY 1",
    "summary_filtered": f"WITH {_PSMS} {_SUMMARY.format(keep='good')}",
    "summary_all": f"WITH {_PSMS} {_SUMMARY.format(keep='true')}",
    "charge_histogram": f"WITH {_PSMS} SELECT charge, count(*) AS n FROM p WHERE q_value IS NULL OR q_value <= 0.01 GROUP BY 1",
    "medians": f"WITH {_PSMS} SELECT charge, median(score) AS mean_of_middle, quantile_disc(score, 0.5) AS lower_middle, list_sort(list(score))[count(*) // 2 + 1] AS upper_middle FROM p GROUP BY 1",
    "import_by_run": "SELECT n_name AS run, count(*) AS imported, count(*) FILTER (l_tax > 0) AS matched, count(*) FILTER (l_tax > 0 AND l_discount <= 0.02) AS psms_at_q, count(DISTINCT CASE WHEN l_tax > 0 AND l_discount <= 0.02 THEN l_partkey END) AS peptides_at_q, count(DISTINCT CASE WHEN l_tax > 0 THEN l_orderkey END) AS scans, round(count(*) FILTER (l_tax > 0 AND l_discount <= 0.02)::DOUBLE / count(*) FILTER (l_tax > 0), 9) AS identification_rate FROM lineitem JOIN nation ON l_suppkey % 25 = n_nationkey GROUP BY 1",
    "q_null_passes": f"WITH {_PSMS} SELECT charge, count(*) AS n, count(*) FILTER (q_value IS NULL) AS without_q FROM p WHERE q_value IS NULL OR q_value <= 0.02 GROUP BY 1",
    "candidate_cap": "SELECT l_suppkey, rank::INT AS rank, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 20",
    "history": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "export_lines": """SELECT l_orderkey::VARCHAR AS scan, 'a  ' || l_shipdate::DATE AS sequence, l_linenumber::VARCHAR AS charge, printf('%.8f', l_quantity) AS precursor_mz, printf('%.8f', l_discount) AS calculated_mz, printf('%.2f', l_tax) AS delta_ppm, printf('%.6f', l_extendedprice) AS score,
CASE WHEN l_tax > 0 THEN printf('%.6f', l_discount) ELSE 'NA' END AS q_value, l_partkey || ';' || l_suppkey AS proteins, CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS is_decoy, l_linestatus AS modifications FROM lineitem""",
    "score_histogram": "SELECT floor((l_extendedprice / l_quantity - 900) / 10)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1",
}


def _mass_case(c: str) -> str:
    from massq.functions.chem import RESIDUES

    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in RESIDUES.items()) + " ELSE 0 END"


SQL["hamming_names"] = f"""WITH n AS (SELECT DISTINCT upper(p_name) AS a FROM part), p AS (SELECT x.a, y.a AS b FROM n x JOIN n y ON len(x.a) = len(y.a) AND x.a < y.a AND hamming(x.a, y.a) <= 4),
d AS (SELECT a, b, list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i]) AS i FROM p)
SELECT a, b, len(i)::INT AS mismatches, '[' || array_to_string(list_transform(i, lambda k: (k - 1) || ':' || a[k] || '->' || b[k]), ',') || ']' AS detail,
a <> b AND translate(a, 'I', 'L') = translate(b, 'I', 'L') AS only_il, len(i) = 1 AND a[i[1]] || b[i[1]] IN ('QK', 'KQ') AS single_qk,
round(list_sum(list_transform(i, lambda k: {_mass_case("b[k]")} - {_mass_case("a[k]")})), 6) AS delta_mass FROM d"""
