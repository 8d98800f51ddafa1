"""Queries through the session's tools on annotations, and through readers that no other query reaches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massq.api import Session
from massq.functions import chem
from massq.operators import advice, validate
from massq.operators import digest as D
from massq.operators import spectra as S
from massq.operators.shared import shared_path
from massq.plans.files import _CAND, _MADE, _made, write_mgf, write_mzml, _number
from massq.plans.engine import _PROTON, _ions
from massq.plans.matching import table
from massq.plans.signals import _S, _rounded, spectra
from massq.sources import results as R


def custom_json(spark, d):
    """Parts as results in JSON, a file of one array for each brand, read again."""
    one = F.struct(F.upper("p_name").alias("sequence"), (F.col("p_size") % 4).alias("charge"), F.array(F.array(F.col("p_size") % 3, F.lit(35))).alias("modify"), (F.col("p_size") / 2).alias("rt"), F.col("p_retailprice").alias("precursor_mz"), F.concat(F.lit("run"), (F.col("p_size") % 5).cast("string")).alias("raw_title"), F.when(F.col("p_size") > 5, F.array("p_brand", "p_type")).alias("protein_names"))
    rows, path = table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.collect_list(one)).alias("value")), f"{shared_path(spark)}.json"
    rows.withColumn("b", F.replace("p_brand", F.lit("#"), F.lit("-"))).select("value", "b").repartition("b").write.partitionBy("b").text(path)
    found = R.read_json(spark, path)
    return found.groupBy("run", "charge").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("peptides"), F.round(F.sum("precursor_mz"), 3).alias("mz"), F.round(F.sum("rt_min"), 3).alias("rt"), F.sum(F.size("accessions")).cast("long").alias("accessions"), F.max("modified").alias("last_modified"))


def unimod_table(spark, d):
    """Parts as a Unimod dictionary in XML, read again: a site is a letter, an end of the peptide is none."""
    site = lambda c: F.concat(F.lit('<specificity site="'), c, F.lit('"/>'))
    head = F.concat(F.lit('<mod record_id="'), F.col("p_partkey").cast("string"), F.lit('" title="'), F.col("p_name"), F.lit('">'))
    body = F.concat(site(F.upper(F.substring("p_name", 1, 1))), site(F.lit("N-term")), site(F.upper(F.substring("p_name", 3, 1))), F.lit('<delta mono_mass="'), F.col("p_retailprice").cast("string"), F.lit('"/></mod>'))
    rows, path = table(spark, d, "part").select(F.concat(head, body).alias("value")), f"{shared_path(spark)}.xml"

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # each part is a dictionary of its own
        yield pd.DataFrame({"value": ["<unimod>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</unimod>"]})

    rows.mapInPandas(framed, "value string").write.text(path)
    return R.unimod(spark, path).select("id", "title", F.round("mass", 6).alias("mass"), "residues")


def recommended(spark, d):
    """Parameters for every run, from its spectra's summary."""
    return advice.recommended(S.summary(spectra(spark, d)))


def validation_metadata(spark, d):
    """lineitem as run metadata: which rules are broken, and how often."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.when(F.col("l_linenumber") == 7, " ").otherwise("engine").alias("engine"), F.when(F.col("l_linestatus") == "F", "1").otherwise("").alias("engine_version"), F.when(F.col("l_tax") > 0, F.array("l_returnflag")).otherwise(F.array().cast("array<string>")).alias("input_files"), F.when(F.col("l_quantity") > 5, F.col("l_quantity") - 10).alias("seconds"), F.col("l_discount").alias("precursor_tolerance"), F.lit(20.0).alias("fragment_tolerance"), F.col("l_linenumber").alias("missed"), F.lit(3).alias("max_mods"), F.lit(7).alias("shortest"), F.col("l_quantity").cast("int").alias("longest"))
    return validate.run_metadata(rows).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def validation_decisions(spark, d):
    """conversations as decisions: the share of a turn is its confidence, its text what is said."""
    c = table(spark, d, "conversations")
    rows = c.select((F.col("turn") / 4).alias("confidence"), F.coalesce("text", F.lit("")).alias("explanation"), F.when(F.col("conv_id") % 5 > 0, F.col("role")).otherwise(" ").alias("input_summary"))
    return validate.decisions(rows).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def _numbered(spark, d) -> DataFrame:
    """The spectra of benchmark peptides with scan numbers by peptide."""
    rows = _made(spark, d)
    return rows.withColumn("scan", F.row_number().over(Window.orderBy("run")))  # a few hundred


def tool_batch_annotate(spark, d):
    """Each spectrum under its own peptide, every second with a modification at its first place, and under its reverse with charge 3."""
    rows = _numbered(spark, d)
    own = rows.select("scan", F.col("run").alias("peptide"), F.lit(2).alias("charge"), F.when(F.col("scan") % 2 == 0, F.array(F.struct(F.lit(0).alias("pos"), F.lit(1.5).alias("delta")))).otherwise(F.array().cast("array<struct<pos:int,delta:double>>")).alias("mods"))
    turned = rows.select("scan", D.reverse_decoy(F.col("run")).alias("peptide"), F.lit(3).alias("charge"), F.array().cast("array<struct<pos:int,delta:double>>").alias("mods"))
    found = Session(spark).batch_annotate_spectra(write_mgf(rows, F.col("scan")), own.unionByName(turned))
    return found.select("scan", "peptide", "charge", "matched", "total", F.round("score", 6).alias("score"))


def tool_annotate(spark, d):
    """The ions of the last spectrum's peptide."""
    rows = _numbered(spark, d)
    last = rows.agg(F.max(F.struct("scan", "run")).alias("m")).first().m
    found = Session(spark).annotate_spectrum(write_mgf(rows, F.col("scan")), last.scan, last.run)
    return found.where("length(type) = 1").select("label", "matched", F.round(F.col("mz") + 1e-8, 4).alias("mz"))


def tool_provenance(spark, d):
    """The last spectrum's peaks between its peptide and the reverse."""
    rows = _numbered(spark, d)
    last = rows.agg(F.max(F.struct("scan", "run")).alias("m")).first().m
    turned = last.run[:-1][::-1] + last.run[-1]
    return _rounded(Session(spark).annotate_provenance(write_mgf(rows, F.col("scan")), last.scan, last.run, turned).select("trap_only", "target_only", "shared", "unassigned", "shared_ratio"))


def tool_precursors(spark, d):
    """What isotope patterns show for the last MS2 scan alone: as for that scan of the whole file. No SQL: a greedy choice; tests compare it with a plain version."""
    rows = spectra(spark, d)
    last = rows.where("ms_level = 2").agg(F.max(_number())).first()[0]
    return Session(spark).extract_spectrum_precursors(write_mzml(rows, _number()), last).select("scan", F.size("precursors").cast("long").alias("precursors"), "method")


QUERIES = {f.__name__: f for f in (custom_json, unimod_table, recommended, validation_metadata, validation_decisions, tool_batch_annotate, tool_annotate, tool_provenance, tool_precursors)}

_NUMBERED = f"{_CAND.format('false')}, {_MADE}, ns AS (SELECT run, row_number() OVER (ORDER BY run)::INT AS scan FROM sp), last AS (SELECT max(scan) AS scan FROM ns), la AS (SELECT run AS p, reverse(run[1:len(run) - 1]) || right(run, 1) AS q FROM ns JOIN last USING (scan))"
SQL = {
    "custom_json": """SELECT 'run' || p_size % 5 AS run, (p_size % 4)::INT AS charge, count(*) AS n, count(DISTINCT upper(p_name)) AS peptides, round(sum(p_retailprice), 3) AS mz, round(sum(p_size / 2), 3) AS rt, sum(CASE WHEN p_size > 5 THEN 2 ELSE 0 END)::BIGINT AS accessions, max('[[' || p_size % 3 || ',35]]') AS last_modified FROM part GROUP BY 1, 2""",
    "unimod_table": """SELECT p_partkey::INT AS id, p_name AS title, round(p_retailprice, 6) AS mass, array_to_string(list_sort(list_distinct([upper(p_name[1]), upper(p_name[3])])), '') AS residues FROM part""",
    "recommended": f"""WITH {_S}, m AS (SELECT run, quantile_disc(n, 0.5) AS peaks, max(hi) AS top, median(CASE WHEN ms_level = 2 THEN 2 * half END) AS width FROM s GROUP BY 1), i AS (SELECT *, CASE WHEN peaks >= 100 OR top >= 1500 THEN 'high_resolution' WHEN peaks > 0 THEN 'low_resolution' ELSE 'unknown' END AS instrument FROM m)
SELECT run, instrument, coalesce(width, 0) > 5 AS wide, CASE WHEN instrument = 'low_resolution' THEN 20.0 ELSE 10.0 END::DOUBLE AS precursor_tolerance, CASE WHEN instrument = 'low_resolution' THEN 0.1 ELSE 20.0 END::DOUBLE AS fragment_tolerance, CASE WHEN instrument = 'low_resolution' THEN 'Da' ELSE 'ppm' END AS fragment_unit, CASE WHEN instrument = 'unknown' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM i""",
    "validation_metadata": """SELECT concat_ws(',', CASE WHEN l_quantity > 5 AND l_quantity < 10 THEN 'seconds' END, CASE WHEN l_tax <= 0 THEN 'input_files' END, CASE WHEN l_linenumber = 7 THEN 'engine' END, CASE WHEN l_linestatus <> 'F' THEN 'engine_version' END, CASE WHEN l_discount <= 0 THEN 'precursor_tolerance' END, CASE WHEN l_linenumber > 5 THEN 'missed' END, CASE WHEN l_quantity::INT < 7 THEN 'lengths' END) AS violations, count(*) AS n FROM lineitem GROUP BY 1""",
    "validation_decisions": """SELECT concat_ws(',', CASE WHEN turn > 4 THEN 'confidence' END, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'explanation' END, CASE WHEN conv_id % 5 = 0 THEN 'input_summary' END) AS violations, count(*) AS n FROM conversations GROUP BY 1""",
    "tool_batch_annotate": f"""WITH {_NUMBERED}, a AS (SELECT scan, run, run AS p, 2 AS charge, CASE WHEN scan % 2 = 0 THEN 1.5 ELSE 0 END::DOUBLE AS moved FROM ns UNION ALL SELECT scan, run, reverse(run[1:len(run) - 1]) || right(run, 1), 3, 0 FROM ns),
i AS ({_ions("a")}), z AS (SELECT scan, run, p, charge, (fragment + CASE WHEN kind = 'b' THEN moved ELSE 0 END - l + z * {_PROTON}) / z AS mz FROM i, (VALUES (0.0::DOUBLE), ({chem.WATER}::DOUBLE), ({chem.AMMONIA}::DOUBLE)) AS ls(l), (VALUES (1), (2)) AS zs(z) WHERE z = 1 OR charge >= 3),
h AS (SELECT scan, p, charge, EXISTS (SELECT 1 FROM peak WHERE peak.run = z.run AND abs(pk - mz) <= mz * 20e-6) AS hit FROM z)
SELECT scan, p AS peptide, charge::INT AS charge, count(*) FILTER (hit) AS matched, count(*) AS total, round(count(*) FILTER (hit) / count(*), 6) AS score FROM h GROUP BY 1, 2, 3""",
    "tool_annotate": f"""WITH {_NUMBERED}, c AS (SELECT p, p AS run FROM la), i AS ({_ions("c")})
SELECT kind || n || '+1' AS label, EXISTS (SELECT 1 FROM peak WHERE peak.run = i.run AND abs(pk - fragment - {_PROTON}) <= (fragment + {_PROTON}) * 20e-6) AS matched, round(fragment + {_PROTON} + 1e-8, 4) AS mz FROM i""",
    "tool_provenance": f"""WITH {_NUMBERED}, c AS (SELECT p, 'a' AS side, p AS run FROM la UNION ALL SELECT q, 'b', p FROM la), i AS ({_ions("c")}), z AS (SELECT run, side, (fragment + z * {_PROTON}) / z AS mz FROM i, (VALUES (1), (2)) AS v(z)),
m AS (SELECT z.run, side, arg_min(pk, struct_pack(d := abs(pk - mz), pk := pk)) AS pk FROM z JOIN peak ON peak.run = z.run AND abs(pk - mz) <= mz * 20e-6 GROUP BY z.run, side, mz),
k AS (SELECT DISTINCT pk FROM peak JOIN la ON peak.run = la.p), f AS (SELECT k.pk, EXISTS (SELECT 1 FROM m WHERE m.pk = k.pk AND side = 'a') AS a, EXISTS (SELECT 1 FROM m WHERE m.pk = k.pk AND side = 'b') AS b FROM k)
SELECT count(*) FILTER (a AND NOT b) AS trap_only, count(*) FILTER (b AND NOT a) AS target_only, count(*) FILTER (a AND b) AS shared, count(*) FILTER (NOT a AND NOT b) AS unassigned, round(count(*) FILTER (a AND b)::DOUBLE / greatest(1, count(*) FILTER (a OR b)), 6) AS shared_ratio FROM f""",
}
