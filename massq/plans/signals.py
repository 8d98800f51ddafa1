"""Queries on spectra, chromatograms, annotation and streams.

``events`` stand in for scans: a user is a run, a day a scan, values are m/z and the
property k the intensity. ``embeddings`` are profiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massq.functions import chem
from massq.functions import exprs as X
from massq.operators import digest as D
from massq.operators import spectra as S
from massq.operators.shared import materialise, shared_path
from massq.plans.matching import SQL as _MATCHING_SQL
from massq.plans.matching import scans, table
from massq.plans.proteins import _PEP, _mass, sequences
from massq.streaming import events as streams
from massq.streaming import pairing

_K = "$.k"


def spectra(spark, d) -> DataFrame:
    """One spectrum per user and day: every fifth day an MS1; the precursor window is as wide as the day number."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.dayofmonth("ts").alias("scan"), "event_id", "value", F.get_json_object("props", _K).cast("double").alias("k"))
    g = e.groupBy("run", "scan").agg(F.sort_array(F.collect_list(F.struct(F.col("value").alias("mz"), "event_id", F.col("k").alias("i")))).alias("p"))
    level = F.when(F.col("scan") % 5 == 0, 1).otherwise(2)
    half = F.col("scan") / 2.0
    iso = F.struct(F.floor(F.element_at("p.mz", 1) / 50).cast("double").alias("target"), half.alias("lower"), half.alias("upper"))
    one = F.struct(F.element_at("p.mz", 1).alias("mz"), (F.col("scan") % 4 + 1).alias("charge"), F.lit(None).cast("double").alias("intensity"), iso.alias("isolation"), F.lit(None).cast("int").alias("source_scan"))
    return g.select("run", "scan", level.alias("ms_level"), (F.col("scan") * 24.0).alias("rt_min"), F.when(level == 2, F.array(one)).otherwise(F.array().cast(f"array<{S.PRECURSOR}>")).alias("precursors"), F.col("p.mz").alias("mz"), F.col("p.i").alias("intensity"), F.lit("centroid").alias("representation"))


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def spectrum_summary(spark, d):
    return _rounded(S.summary(spectra(spark, d)))


def spectrum_charges(spark, d):
    return S.charge_histogram(spectra(spark, d))


def scan_metadata(spark, d):
    return S.metadata(spectra(spark, d), 2).select("run", "scan", "rt_min", F.col("isolation.target").alias("target"), F.col("isolation.lower").alias("lower"))


def ms_levels(spark, d):
    s = spectra(spark, d)
    return S.by_level(s, 1).unionByName(S.by_level(s, 2)).groupBy("ms_level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("mz")).cast("long").alias("peaks"))


def acquisition_modes(spark, d):
    return S.acquisition_mode(spectra(spark, d), 15.5)


def dia_windows(spark, d):
    return S.dia_windows(spectra(spark, d))


def spectrum_violations(spark, d):
    e = table(spark, d, "embeddings")
    rows = e.select(F.lit("e").alias("run"), F.col("vec_id").cast("int").alias("scan"), F.array().cast(f"array<{S.PRECURSOR}>").alias("precursors"), F.transform("embedding", lambda x, i: (i + 1).cast("double")).alias("mz"), F.transform("embedding", lambda x: x.cast("double")).alias("intensity"))
    return S.violations(rows).select("scan", F.array_join("violations", ",").alias("violations"))


def centroids(spark, d):
    e = table(spark, d, "embeddings")
    found = F.explode(S.centroids(F.transform("embedding", lambda x, i: (i + 1).cast("double")), F.transform("embedding", lambda x: x.cast("double"))))
    return e.select("vec_id", found.alias("p")).select("vec_id", F.round("p.mz", 5).alias("mz"), F.round("p.intensity", 6).alias("intensity"))


def co_sorted(spark, d):
    """Peaks sorted by the embedding's value, its place carried along."""
    e = table(spark, d, "embeddings")
    p = S.sorted_peaks(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x, i: i.cast("double")))
    return e.select("vec_id", F.posexplode(p).alias("rank", "p")).select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("p.mz", 6).alias("mz"), F.col("p.intensity").cast("long").alias("place"))


def trimmed_peaks(spark, d):
    rows = spectra(spark, d).select("run", "scan", X.trim_peaks(F.col("mz"), F.col("intensity"), F.lit(250.0), 100.0).alias("p"))
    return rows.select("run", "scan", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0.0), lambda t, x: t + x["intensity"]).alias("total"))


_IONS = ((50.0, "a"), (150.0, "b"), (250.0, "c"), (350.0, "d"), (450.0, "e"))


def _ions(spark, d) -> DataFrame:
    ions = F.array(*[F.struct(F.lit(m).alias("ion_mz"), F.lit(n).alias("label")) for m, n in _IONS])
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("run")).distinct().select("run", F.inline(ions))


def _xic(spark, d, rule):
    return S.chromatograms(spectra(spark, d), _ions(spark, d), 50_000, rule)


def xic_max(spark, d):
    return _xic(spark, d, "max").select("run", "label", "scan", "intensity")


def xic_sum(spark, d):
    return _xic(spark, d, "sum").select("run", "label", "scan", "intensity", "observed_mz")


def xic_nearest(spark, d):
    return _xic(spark, d, "nearest").select("run", "label", "scan", "observed_mz")


def xic_top_traces(spark, d):
    traces = S.top_traces(_xic(spark, d, "sum"), 2)
    return traces.groupBy("run", "label").agg(F.sum("intensity").alias("total"), F.count(F.lit(1)).alias("points"))


def cycles_around(spark, d):
    """Three scans before and after each run's largest MS1 scan, among all of the run."""
    s = spectra(spark, d).select("run", "scan", "ms_level")
    last = s.groupBy("run").agg(F.max(F.when(F.col("ms_level") == 1, F.col("scan"))).alias("t"))
    return S.cycles_around(s.join(last, "run"), ("run",), F.col("scan") == F.col("t"), 3).select("run", "scan")


def pseudo_spectra(spark, d):
    rows = S.pseudo_spectra(scans(spark, d))
    return rows.groupBy("ms_level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("precursors")).cast("long").alias("precursors"))


def top_unmatched(spark, d):
    """The three most intense peaks of each spectrum, as the 3-D view thins them."""
    p = spectra(spark, d).select("run", "scan", F.posexplode(F.arrays_zip("mz", "intensity")).alias("i", "p")).select("run", "scan", "i", "p.mz", "p.intensity")
    rank = F.row_number().over(Window.partitionBy("run", "scan").orderBy(F.desc("intensity"), "i"))
    return p.withColumn("r", rank).where("r <= 3").select("run", "scan", "mz", "intensity")


def same_windows(spark, d):
    """How many pairs of a run's consecutive MS2 windows count as the same."""
    m = S.metadata(spectra(spark, d), 2).select("run", "scan", F.col("isolation.target").alias("t"), (F.col("isolation.lower") + F.col("isolation.upper")).alias("w"))
    before = Window.partitionBy("run").orderBy("scan")
    rows = m.withColumns({"pt": F.lag("t").over(before), "pw": F.lag("w").over(before)}).where("pt is not null")
    return rows.groupBy("run").agg(F.count_if(X.same_window(F.col("pt"), F.col("pw"), F.col("t"), F.col("w"))).alias("same"), F.count(F.lit(1)).alias("pairs"))


def _theory(spark, d) -> tuple[DataFrame, DataFrame]:
    """Spectra made of every second theoretical ion of each peptide of documents, moved by 2 ppm; and the peptides, each a run of its own."""
    peptides = D.digest(sequences(spark, d), missed=0).select("peptide").distinct().select(F.col("peptide").alias("run"), F.lit(1).alias("scan"), "peptide")
    peptides = materialise(peptides)
    ions = F.filter(chem.theoretical_ions(F.col("peptide"), None, 1), lambda x: x["number"] % 2 == 0)
    peaks = F.array_sort(F.transform(ions, lambda x: F.struct((x["mz"] * (1 + 2e-6)).alias("mz"), x["number"].cast("double").alias("intensity"))))
    return peptides.select("run", "scan", peaks.alias("p")).select("run", "scan", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity")), peptides


def annotation(spark, d):
    s, p = _theory(spark, d)
    a = S.annotate(s, p, 5.0, 1, losses=False)
    return a.join(p, ["run", "scan"]).groupBy("peptide").agg(F.count(F.lit(1)).alias("ions"), F.count_if("matched").alias("matched"), F.coalesce(F.round(F.min("delta_ppm"), 3), F.lit(0.0)).alias("least_ppm"))


def annotation_scores(spark, d):
    s, p = _theory(spark, d)
    return _rounded(S.annotation_scores(S.annotate(s, p), s).drop("scan").withColumnRenamed("run", "peptide"))


def fragment_provenance(spark, d):
    """Peaks of each peptide's spectrum explained by the peptide, by its reverse, or by both."""
    s, p = _theory(spark, d)
    decoy = p.withColumn("peptide", D.reverse_decoy(F.col("peptide")))
    return _rounded(S.provenance(S.annotate(s, p, losses=False), S.annotate(s, decoy, losses=False), s).drop("scan").withColumnRenamed("run", "peptide"))


def _timed(spark, d) -> DataFrame:
    """events as single scans, views as MS1: hours of the month are minutes, a window of k around the value."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", _K).cast("double")
    one = F.struct(F.col("value").alias("mz"), F.lit(2).alias("charge"), F.lit(None).cast("double").alias("intensity"), F.struct(F.col("value").alias("target"), k.alias("lower"), k.alias("upper")).alias("isolation"), F.lit(None).cast("int").alias("source_scan"))
    return e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").cast("int").alias("scan"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("ms_level"), (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("double").alias("rt_min"), F.array(one).alias("precursors"))


def _wanted(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("run"), (F.col("o_orderkey") % 720).cast("double").alias("rt"), (F.col("o_orderkey") % 487 + 1).cast("double").alias("heavy_mz"))


def heavy_dda(spark, d):
    return S.heavy_scans_dda(_timed(spark, d), _wanted(spark, d), 20_000)


def heavy_dia(spark, d):
    return S.heavy_scans_dia(_timed(spark, d), _wanted(spark, d), 100.0)


def ms1_probe(spark, d):
    return S.probe_ms1(spectra(spark, d), _wanted(spark, d).withColumnRenamed("heavy_mz", "mz"), 50_000, 100.0)


def multi_target(spark, d):
    """Each peptide's spectrum against itself as the trap, its reverse and its I/L form as candidates."""
    s, p = _theory(spark, d)
    of = lambda name, c: S.annotate(s, p.withColumn("peptide", c), losses=False).withColumn("candidate", F.lit(name))
    found = of("trap", F.col("peptide")).unionByName(of("reverse", D.reverse_decoy(F.col("peptide")))).unionByName(of("folded", X.fold_il(F.col("peptide"))))
    return _rounded(S.multi_provenance(found, s).drop("scan").withColumnRenamed("run", "peptide"))


def isotope_precursors(spark, d):
    """Precursors that isotope patterns of the MS1 scans show: no SQL, a greedy choice within a spectrum."""
    found = S.extract_precursors(spectra(spark, d), tolerance=0.5, ratio=0.05, rise=3.0)
    return found.select("run", "scan", F.size("precursors").cast("long").alias("precursors"), F.round(F.element_at("precursors", 1)["mz"], 4).alias("mz"))


def _stream(spark, d):
    return streams.source(spark, d, "events.parquet")


def stream_tumbling(spark, d):
    return _rounded(streams.run_available(streams.binned(_stream(spark, d), "1 hour")), 4)


def _arriving(spark, d, cuts: int = 5):
    """events as a stream of scans in ``cuts`` batches, and the ends of all runs after them."""
    rows = scans(spark, d).select("run", "scan", "ms_level", "rt_min", F.col("precursors")[0]["source_scan"].alias("source"))
    least, most = rows.agg(F.min("scan"), F.max("scan")).first()
    folder = f"{shared_path(spark)}/arriving"
    width = max(1, -(-(most - least + 1) // cuts)) if most is not None else 1
    for k in range(cuts):  # a file after the other, as they would come
        rows.where(F.floor((F.col("scan") - least) / width) == k).coalesce(1).write.mode("append").parquet(folder)
    ends = rows.select("run").distinct().select("run", F.lit(0).alias("scan"), F.lit(0).alias("ms_level"), F.lit(0.0).alias("rt_min"), F.lit(None).cast("int").alias("source"))
    ends.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_pairing(spark, d):
    """MS2 scans paired with the MS1 of their run as they arrive: the same as ``ms1_correlation`` over the whole table."""
    return streams.run_available(pairing.paired(_arriving(spark, d)), mode="append")


def stream_sliding(spark, d):
    return _rounded(streams.run_available(streams.binned(_stream(spark, d), "6 hours", "3 hours")), 4)


def stream_sessions(spark, d):
    return _rounded(streams.run_available(streams.sessions(_stream(spark, d), "12 hours")), 4)


QUERIES = {f.__name__: f for f in (spectrum_summary, spectrum_charges, scan_metadata, ms_levels, acquisition_modes, dia_windows, spectrum_violations, centroids, co_sorted, trimmed_peaks, xic_max, xic_sum, xic_nearest, xic_top_traces, cycles_around, pseudo_spectra, top_unmatched, same_windows, annotation, annotation_scores, fragment_provenance, heavy_dda, heavy_dia, ms1_probe, multi_target, isotope_precursors, stream_tumbling, stream_sliding, stream_sessions, stream_pairing)}

_E = "e AS (SELECT user_id::VARCHAR AS run, day(ts)::INT AS scan, event_id, value AS mz, (props->>'$.k')::DOUBLE AS i FROM events)"
_S = f"{_E}, s AS (SELECT run, scan, CASE WHEN scan % 5 = 0 THEN 1 ELSE 2 END AS ms_level, scan * 24.0::DOUBLE AS rt_min, count(*) AS n, min(mz) AS lo, max(mz) AS hi, floor(min(mz) / 50)::DOUBLE AS target, scan / 2.0::DOUBLE AS half FROM e GROUP BY 1, 2)"
_X = f"""{_E}, ion(t, label) AS (VALUES {", ".join(f"({m}::DOUBLE, '{n}')" for m, n in _IONS)}), sc AS (SELECT DISTINCT run, scan FROM e),
h AS (SELECT sc.run, sc.scan, t, label, mz, i, event_id FROM sc CROSS JOIN ion LEFT JOIN e ON e.run = sc.run AND e.scan = sc.scan AND abs(mz - t) <= t * 50000 * 1e-6)"""
_P = "v AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings), w AS (SELECT vec_id, i, embedding[i]::DOUBLE AS b, embedding[i - 1]::DOUBLE AS a, embedding[i + 1]::DOUBLE AS c, len(embedding) AS n, list_max(embedding)::DOUBLE AS top FROM v)"
_T = "t AS (SELECT user_id, event_id::INT AS scan, day(ts) * 24 + hour(ts) AS rt, value, (props->>'$.k')::DOUBLE AS k FROM events WHERE event_type <> 'view'), o AS (SELECT o_orderkey AS id, o_custkey, o_orderkey % 720 AS ort, (o_orderkey % 487 + 1)::DOUBLE AS hm FROM orders)"
SQL = {
    "stream_pairing": _MATCHING_SQL["ms1_correlation"],
    "heavy_dda": f"WITH {_T} SELECT id, scan FROM (SELECT id, scan, row_number() OVER (PARTITION BY id ORDER BY abs(rt - ort), scan) AS r FROM o JOIN t ON o_custkey = user_id AND abs(value - hm) / hm * 1e6 < 20000) WHERE r = 1",
    "heavy_dia": f"WITH {_T} SELECT id, scan FROM (SELECT id, scan, row_number() OVER (PARTITION BY id ORDER BY abs(rt - ort), scan) AS r FROM o JOIN t ON o_custkey = user_id AND hm BETWEEN value - k AND value + k) WHERE r = 1",
    "ms1_probe": f"""WITH {_S}, o AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS run, o_orderkey % 720 AS ort, (o_orderkey % 487 + 1)::DOUBLE AS m FROM orders),
n AS (SELECT id, run, m, scan FROM (SELECT id, o.run, m, scan, row_number() OVER (PARTITION BY id ORDER BY abs(rt_min - ort), rt_min, scan) AS r FROM o JOIN s ON s.run = o.run AND ms_level = 1 AND abs(rt_min - ort) <= 100) WHERE r = 1)
SELECT id, n.scan, arg_min(mz, struct_pack(a := -i, b := mz)) AS mz FROM n LEFT JOIN e ON e.run = n.run AND e.scan = n.scan AND abs(mz - m) <= m * 50000 * 1e-6 GROUP BY 1, 2""",
    "spectrum_summary": f"""WITH {_S} SELECT run, count(*) AS spectra, count(*) FILTER (ms_level = 1) AS ms1, count(*) FILTER (ms_level = 2) AS ms2, min(lo) AS mz_min, max(hi) AS mz_max, min(rt_min) AS rt_from, max(rt_min) AS rt_to,
quantile_disc(n, 0.5)::INT AS median_peaks, coalesce(median(CASE WHEN ms_level = 2 THEN 2 * half END), 0) AS median_window FROM s GROUP BY 1""",
    "spectrum_charges": f"WITH {_S} SELECT run, (scan % 4 + 1)::INT AS charge, count(*) AS n FROM s WHERE ms_level = 2 GROUP BY 1, 2",
    "scan_metadata": f"WITH {_S} SELECT run, scan, rt_min, target, half AS lower FROM s WHERE ms_level = 2",
    "ms_levels": f"WITH {_S} SELECT ms_level::INT AS ms_level, count(*) AS n, sum(n)::BIGINT AS peaks FROM s GROUP BY 1",
    "acquisition_modes": f"WITH {_S} SELECT run, CASE WHEN median(CASE WHEN ms_level = 2 THEN scan END) IS NULL THEN 'Unknown' WHEN median(CASE WHEN ms_level = 2 THEN scan END) > 15.5 THEN 'DIA' ELSE 'DDA' END AS mode FROM s GROUP BY 1",
    "dia_windows": f"WITH {_S} SELECT DISTINCT run, target, half AS lower, half AS upper FROM s WHERE ms_level = 2",
    "spectrum_violations": "SELECT vec_id::INT AS scan, concat_ws(',', CASE WHEN vec_id < 1 THEN 'scan' END, CASE WHEN list_min(embedding) < 0 THEN 'intensity' END) AS violations FROM embeddings",
    "centroids": f"""WITH {_P}, x AS (SELECT vec_id, i, b, CASE WHEN a - 2 * b + c <> 0 THEN 0.5 * (a - c) / (a - 2 * b + c) ELSE 0 END AS sh FROM w WHERE i > 1 AND i < n AND b > a AND b >= c AND b >= top * 0.0)
SELECT vec_id, round(i + CASE WHEN abs(sh) <= 0.5 THEN sh ELSE 0 END, 5) AS mz, round(b, 6) AS intensity FROM x""",
    "co_sorted": f"WITH {_P} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY b, i) - 1 AS rank, round(b, 6) AS mz, i - 1 AS place FROM w",
    "trimmed_peaks": f"WITH {_E} SELECT run, scan, count(*) FILTER (abs(mz - 250) <= 100) AS n, coalesce(sum(i) FILTER (abs(mz - 250) <= 100), 0) AS total FROM e GROUP BY 1, 2",
    "xic_max": f"WITH {_X} SELECT run, label, scan, coalesce(max(i), 0) AS intensity FROM h GROUP BY 1, 2, 3",
    "xic_sum": f"WITH {_X} SELECT run, label, scan, coalesce(sum(i), 0) AS intensity, arg_min(mz, struct_pack(d := abs(mz - t), m := mz)) AS observed_mz FROM h GROUP BY 1, 2, 3",
    "xic_nearest": f"WITH {_X} SELECT run, label, scan, arg_min(mz, struct_pack(d := abs(mz - t), m := mz)) AS observed_mz FROM h GROUP BY 1, 2, 3",
    "xic_top_traces": f"""WITH {_X}, q AS (SELECT run, label, coalesce(sum(i), 0) AS total, count(DISTINCT scan) AS points FROM h GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY total DESC, label) AS r FROM q) SELECT run, label, total, points FROM r WHERE r <= 2 AND total > 0""",
    "cycles_around": f"WITH {_S}, r AS (SELECT run, scan, row_number() OVER (PARTITION BY run ORDER BY scan) AS r, max(CASE WHEN ms_level = 1 THEN scan END) OVER (PARTITION BY run) AS t FROM s), m AS (SELECT run, r AS tr FROM r WHERE scan = t) SELECT r.run, r.scan FROM r JOIN m USING (run) WHERE abs(r.r - tr) <= 3",
    "pseudo_spectra": "SELECT CASE WHEN event_type = 'view' THEN 1 ELSE 2 END::INT AS ms_level, count(*) AS n, count(*) AS precursors FROM events GROUP BY 1",
    "top_unmatched": f"WITH {_E} SELECT run, scan, mz, i AS intensity FROM (SELECT *, row_number() OVER (PARTITION BY run, scan ORDER BY i DESC, mz, event_id) AS r FROM e) WHERE r <= 3",
    "same_windows": f"WITH {_S}, m AS (SELECT run, scan, target AS t, 2 * half AS w, lag(target) OVER o AS pt, lag(2 * half) OVER o AS pw FROM s WHERE ms_level = 2 WINDOW o AS (PARTITION BY run ORDER BY scan)) SELECT run, count(*) FILTER (abs(pt - t) < 1 AND abs(pw - w) / pw < 0.2) AS same, count(*) AS pairs FROM m WHERE pt IS NOT NULL GROUP BY 1",
    "stream_tumbling": "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY 1, 2",
    "stream_sliding": "WITH b AS (SELECT event_type, value, time_bucket(INTERVAL '3 hours', ts) AS t FROM events), w AS (SELECT event_type, value, unnest([t, t - INTERVAL '3 hours']) AS start FROM b) SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM w GROUP BY 1, 2",
    "stream_sessions": """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS cut FROM events), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""",
}


def _ion_tables(name: str, variant: str, losses: bool = False, charges: int = 2, tolerance: float = 20.0) -> str:
    """CTEs ``name`` (ions of a variant of each peptide) and ``name_h`` (the nearest peak of each that has one)."""
    shifts = "('', 0.0::DOUBLE)" + (", ('w', 18.010565::DOUBLE), ('a', 17.026549::DOUBLE)" if losses else "")
    return f"""{name}_i AS (SELECT peptide, v, unnest(range(1, len(v))) AS n FROM (SELECT peptide, {variant} AS v FROM pep)), {name}_m AS (SELECT peptide, n, {_mass("v[1:n]")} AS b, {_mass("v[len(v) - n + 1:]")} + 18.010565::DOUBLE AS y FROM {name}_i),
{name} AS (SELECT peptide, kind, n, l, z, ((CASE kind WHEN 'b' THEN b ELSE y END) - loss + z * 1.007276::DOUBLE) / z AS mz FROM {name}_m, (VALUES ('b'), ('y')) AS k(kind), (VALUES {shifts}) AS s(l, loss), (SELECT unnest(range(1, {charges + 1})) AS z)),
{name}_h AS (SELECT peptide, kind, n, l, z, mz, arg_min(struct_pack(m := pmz, i := height), struct_pack(d := abs(pmz - mz), m := pmz)) AS p FROM {name} JOIN peak USING (peptide) WHERE abs(pmz - mz) <= mz * {tolerance} * 1e-6 GROUP BY ALL)"""


_SPECTRA = f"{_PEP}, made_i AS (SELECT peptide, unnest(range(2, len(peptide), 2)) AS n FROM pep), peak AS (SELECT peptide, ({_mass('peptide[1:n]')} + 1.007276::DOUBLE) * (1 + 2e-6::DOUBLE) AS pmz, n::DOUBLE AS height FROM made_i UNION ALL SELECT peptide, ({_mass('peptide[len(peptide) - n + 1:]')} + 18.010565::DOUBLE + 1.007276::DOUBLE) * (1 + 2e-6::DOUBLE), n::DOUBLE FROM made_i)"
_REVERSED = "reverse(peptide[1:len(peptide) - 1]) || right(peptide, 1)"
_COUNTS = "count(*) FILTER (t AND NOT o) AS trap_only, count(*) FILTER (o AND NOT t) AS target_only, count(*) FILTER (t AND o) AS shared, count(*) FILTER (NOT t AND NOT o) AS unassigned"
_SHARE = "CASE WHEN trap_only + target_only + shared > 0 THEN round(shared / (trap_only + target_only + shared), 6) ELSE 0 END AS shared_ratio"
SQL |= {
    "annotation": f"""WITH {_SPECTRA}, {_ion_tables("own", "peptide", charges=1, tolerance=5.0)} SELECT peptide, count(*) AS ions, count(p) AS matched, coalesce(round(min((p.m - own.mz) / own.mz * 1e6), 3), 0) AS least_ppm FROM own LEFT JOIN own_h USING (peptide, kind, n, l, z) GROUP BY 1""",
    "annotation_scores": f"""WITH {_SPECTRA}, {_ion_tables("own", "peptide", True)}, a AS (SELECT peptide, count(*) AS total FROM own GROUP BY 1), h AS (SELECT peptide, count(*) AS matched FROM own_h GROUP BY 1), heard AS (SELECT peptide, sum(i) AS i FROM (SELECT DISTINCT peptide, p.m AS m, p.i AS i FROM own_h) GROUP BY 1), every AS (SELECT peptide, sum(height) AS i FROM peak GROUP BY 1)
SELECT peptide, coalesce(matched, 0) AS matched, total, round(coalesce(matched, 0) / total, 6) AS score, coalesce(heard.i, 0) AS matched_intensity, every.i AS total_intensity FROM a LEFT JOIN h USING (peptide) LEFT JOIN heard USING (peptide) JOIN every USING (peptide)""",
    "fragment_provenance": f"""WITH {_SPECTRA}, {_ion_tables("own", "peptide")}, {_ion_tables("rev", _REVERSED)}, c AS (SELECT peptide, pmz, pmz IN (SELECT h.p.m FROM own_h h WHERE h.peptide = peak.peptide) AS t, pmz IN (SELECT h.p.m FROM rev_h h WHERE h.peptide = peak.peptide) AS o FROM peak),
n AS (SELECT peptide, {_COUNTS} FROM c GROUP BY 1) SELECT *, {_SHARE} FROM n""",
    "multi_target": f"""WITH {_SPECTRA}, {_ion_tables("own", "peptide")}, {_ion_tables("rev", _REVERSED)}, {_ion_tables("fold", "translate(peptide, 'I', 'L')")}, claim AS (SELECT DISTINCT peptide, p.m AS pmz, 0 AS who FROM own_h UNION SELECT peptide, p.m, 1 FROM rev_h UNION SELECT peptide, p.m, 2 FROM fold_h),
c AS (SELECT peptide, pmz, coalesce(bool_or(who = 0), false) AS t, coalesce(bool_or(who > 0), false) AS o, count(*) FILTER (who > 0) AS k FROM peak LEFT JOIN claim USING (peptide, pmz) GROUP BY 1, 2),
n AS (SELECT peptide, {_COUNTS}, max(k) AS most_candidates FROM c GROUP BY 1) SELECT *, {_SHARE} FROM n""",
}
