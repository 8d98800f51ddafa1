"""Queries on the index engine, its scores and q-values, occurrences, peak assignment and multi-target provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massq.functions import chem
from massq.operators import digest as D
from massq.operators import engine, fdr, multitarget, search
from massq.operators import spectra as S
from massq.operators.shared import materialise
from massq.plans.files import _CAND, _MADE, _database, _made
from massq.plans.matching import lines, q_sql, table, unit_prices
from massq.plans.proteins import _PEP, _mass, peptides, sequences
from massq.plans.signals import _S, _rounded, _theory, spectra


def _queries(spark, d) -> DataFrame:
    """Spectra of benchmark peptides with a number each."""
    rows = _made(spark, d)
    return engine._numbered(search.precursors(rows).join(rows.select("run", "scan", "mz", "intensity"), ["run", "scan"]), "qid")


def fragment_votes(spark, d):
    """Peaks that each benchmark spectrum shares with each candidate within 500 Da, through the index of fragments."""
    candidates = engine._numbered(search.candidates(_database(spark, d), missed=0), "pid")
    queries = _queries(spark, d)
    votes = engine.fragment_votes(queries, engine.fragment_index(candidates), 500.0, 20.0, "ppm", "Da", (0, 0))
    return votes.join(queries.select("qid", "run"), "qid").join(candidates.select("pid", "peptide"), "pid").select("run", "peptide", "votes")


def open_search(spark, d):
    """Benchmark spectra against the peptides of all documents, 500 Da either way: what is found, how surely, and how far off. No SQL: tests compare it with plain versions of its parts."""
    found = engine.open_search(_made(spark, d), sequences(spark, d), missed=0, drop_decoys=False)
    return found.select("run", "peptide", "is_decoy", "matched", "longest_y", F.round("score", 6).alias("score"), F.round("mass_shift", 4).alias("mass_shift"), F.round("discriminant", 6).alias("discriminant"), F.round("q_value", 6).alias("q_value"))


def engine_search(spark, d):
    """Benchmark spectra through the index engine with isotope errors, 10 ppm: the peptides that it finds, and their isotope errors."""
    found = search.search(_made(spark, d), _database(spark, d), missed=0, engine="hyperscore", drop_decoys=False)
    return found.select("run", F.translate("peptide", "I", "L").alias("peptide"), "isotope_error")


def isotope_pairs(spark, d):
    """Unit prices that are up to three isotope steps off against prices of parts: how many pairs at each error."""
    mass = F.col("unit") + (F.col("l_linenumber") % 5 - 1) * chem.ISOTOPE_STEP
    rows = unit_prices(spark, d).groupBy(mass.alias("neutral_mass")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_orderkey").alias("orders"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("mass"))
    pairs = engine.isotope_join(rows, part.groupBy("mass").agg(F.count(F.lit(1)).alias("parts")), 20.0)  # equal masses meet once
    met = materialise(pairs.groupBy("isotope_error", "mass").agg(F.sum(F.col("lines") * F.col("parts")).alias("n"), F.sum(F.col("orders") * F.col("parts")).alias("orders")))
    found = met.join(part, "mass").groupBy("isotope_error").agg(F.countDistinct("p_partkey").alias("parts"))
    return met.groupBy("isotope_error").agg(F.sum("n").alias("n"), F.sum("orders").alias("orders")).join(found, "isotope_error").select("isotope_error", "n", "parts", "orders")


def strongest_peaks(spark, d):
    """The three most intense peaks of each MS2 spectrum, by m/z."""
    rows = engine.prepared(spectra(spark, d), top=3, fold=False)
    return rows.select("run", "scan", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("run", "scan", "p.mz", "p.intensity")


def folded_isotopes(spark, d):
    """Peaks and intensity of each spectrum before and after isotope peaks are folded: folding moves intensity, and loses none. No SQL: a choice from peak to peak."""
    rows = spectra(spark, d).where("ms_level = 2").withColumnsRenamed({"mz": "m", "intensity": "i"}).withColumns({"mz": F.transform("m", lambda x: x / 25), "intensity": F.col("i")})
    after = engine.prepared(rows, 10_000, True, 3, 3000.0)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    return after.select("run", "scan", F.size("m").cast("long").alias("before"), F.size("mz").cast("long").alias("after"), F.round(total(F.col("i")) - total(F.col("intensity")), 6).alias("lost"))


_TWO = ("l_extendedprice", "l_quantity")


def discriminant_scores(spark, d):
    """Matches by a discriminant of two features: q-values at its scores, by line status."""
    rows = lines(spark, d)
    weights, offset = engine.discriminant(rows, _TWO)
    scored = rows.withColumn("s", engine.discriminant_score(weights, offset, _TWO))
    return scored.groupBy("l_linestatus", "is_decoy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 7).alias("mean"), F.round(F.min("s"), 7).alias("least"), F.round(F.max("s"), 7).alias("most"), F.count_if(F.col("s") > 0).alias("above"))


def picked_peptides(spark, d):
    """Peptides of documents against their reversed forms: a target's score is its mass, a decoy's too where it has a proline, else a little more."""
    p = materialise(peptides(spark, d))
    mass = F.floor(chem.residue_sum(F.col("peptide")) / 7)
    own = p.select("peptide", mass.cast("double").alias("score"), F.lit(False).alias("is_decoy"))
    turned = p.select(D.reverse_decoy(F.col("peptide")).alias("peptide"), (mass + F.when(F.col("peptide").contains("P"), -1.0).otherwise(1.0) * (F.length("peptide") % 3)).cast("double").alias("score"), F.lit(True).alias("is_decoy"))
    return fdr.picked_peptide_q(own.unionByName(turned)).select("peptide", "score", F.round("q_value", 9).alias("q_value"))


def peak_assignment(spark, d):
    """Peaks of each peptide's spectrum with the ion nearest to each, where ions of both charges within 0.3 percent compete."""
    s, p = _theory(spark, d)
    found = S.assigned_peaks(S.annotate(s, p, 3000.0, 2, losses=False))
    return found.groupBy(F.col("run").alias("peptide")).agg(F.count(F.lit(1)).alias("peaks"), F.count_if(F.col("type") == "y").alias("y"), F.sum("number").cast("long").alias("numbers"), F.sum("charge").cast("long").alias("charges"))


def _eluting(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Benchmark peptides as matches that elute one after the other, every third a trap; their spectra, light and heavy; windows of 100."""
    p = materialise(D.digest(_database(spark, d), missed=0).select("peptide").distinct())
    k = F.row_number().over(Window.orderBy("peptide")) - 1  # a few hundred peptides
    mz = chem.mz(chem.peptide_mass(F.col("peptide")), F.lit(2))
    rows = p.withColumn("k", k).select(F.col("k").cast("long").alias("id"), F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("run"), F.when(F.col("k") % 8 == 4, F.col("k")).cast("int").alias("scan"), (F.col("k") / 10).alias("rt_min"), (F.col("k") / 10 - 2.5).alias("rt_start"), (F.col("k") / 10 + 2.5).alias("rt_stop"), mz.alias("precursor_mz"), F.lit(2).alias("charge"), "peptide", F.when(F.col("k") % 4 == 0, "trap").otherwise("target").alias("group"), F.lit("L2").alias("level"))
    rows = materialise(rows)

    def made(number, later: float, center, deltas):
        ions = F.transform(chem.theoretical_ions(F.col("peptide"), deltas, 1), lambda x: x["mz"])
        one = F.array(F.struct(F.col("precursor_mz").alias("mz"), F.lit(2).alias("charge"), F.lit(None).cast("double").alias("intensity"), F.struct(center.alias("target"), F.lit(50.0).alias("lower"), F.lit(50.0).alias("upper")).alias("isolation"), F.lit(None).cast("int").alias("source_scan")))
        return rows.select("run", number.cast("int").alias("scan"), F.lit(2).alias("ms_level"), (F.col("rt_min") + later).alias("rt_min"), one.alias("precursors"), F.array_sort(ions).alias("mz"), F.transform(ions, lambda x: F.lit(1.0)).alias("intensity"), F.lit("centroid").alias("representation"))

    bin_of = lambda m: F.floor(m / 100) * 100.0 + 50.0
    heavy = chem.heavy_mz(F.col("precursor_mz"), F.col("peptide"), F.lit(2))
    scans = made(F.col("id"), 0.0, bin_of(F.col("precursor_mz")), None).unionByName(made(F.col("id") + 1_000_000, 0.001, bin_of(heavy), chem.SILAC))
    windows = materialise(scans).select("run", F.col("precursors")[0]["isolation"]["target"].alias("target")).distinct().withColumns({"lower": F.lit(50.0), "upper": F.lit(49.999)})
    return rows, materialise(scans), windows


def multi_target_trace(spark, d):
    """Each trap's peaks against itself and all targets that elute with it, in its light and in its heavy scan."""
    rows, scans, windows = _eluting(spark, d)
    found = multitarget.trace_multi_target(rows, rows, scans, windows)
    return multitarget.chimeric_share(found).select("id", "scan", "candidates", *[f"light_{c}" for c in multitarget.COUNTS], "heavy_scan", *[f"heavy_{c}" for c in multitarget.COUNTS], F.round("shared_ratio", 6).alias("shared_ratio"))


def heavy_partners(spark, d):
    """The scan that shows the heavy form of each benchmark peptide's spectrum."""
    rows, scans, _ = _eluting(spark, d)
    found = multitarget.heavy_partners(scans, rows.select("id", "run", F.col("id").cast("int").alias("scan"), "peptide", "charge"))
    return found.select("id", "scan", F.round("heavy_mz", 4).alias("heavy_mz"))


def observed_precursors(spark, d):
    """Precursors of the benchmark peptides as MS1 scans show them, light and heavy: every second peptide has one right after it, which shows the next peptide of its run as well in three of four cases."""
    rows, scans, _ = _eluting(spark, d)
    k, mz = F.col("id"), F.col("precursor_mz")
    peak = lambda m, i: F.struct(m.alias("mz"), F.lit(i).alias("intensity"))
    heavy = chem.heavy_mz(mz, F.col("peptide"), F.lit(2))
    peaks = F.array(peak(mz * (1 + 3e-6), 10.0), peak(mz * (1 - 8e-6), F.when(k % 4 == 0, 20.0).otherwise(0.0)), peak(heavy * (1 + 6e-6), 5.0))
    host = F.when(k % 2 == 0, k).otherwise(k - 3)
    shown = rows.select("run", host.alias("host"), peaks.alias("peaks")).where((k % 2 == 0) | (F.col("host") % 8 != 2)).where("host >= 0")
    ms1 = shown.groupBy("run", "host").agg(F.array_sort(F.flatten(F.collect_list("peaks"))).alias("p"))  # two peptides at most
    ms1 = ms1.select("run", (F.col("host") + 2_000_000).cast("int").alias("scan"), F.lit(1).alias("ms_level"), (F.col("host") / 10 + 0.04).alias("rt_min"), F.array().cast(scans.schema["precursors"].dataType).alias("precursors"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"), F.lit("centroid").alias("representation"))
    found = S.observed_precursors(scans.unionByName(ms1), rows.select("id", "run", F.col("id").cast("int").alias("scan"), "peptide", "charge"))
    return found.select("id", "in_ms1", F.round("delta_ppm", 4).alias("delta_ppm"), F.round("heavy_mz", 4).alias("heavy_mz"), F.round("heavy_delta_ppm", 4).alias("heavy_delta_ppm"))


QUERIES = {f.__name__: f for f in (fragment_votes, open_search, engine_search, isotope_pairs, strongest_peaks, folded_isotopes, discriminant_scores, picked_peptides, peak_assignment, multi_target_trace, heavy_partners, observed_precursors)}

_STEP = "1.003355::DOUBLE"
_PROTON = "1.007276::DOUBLE"
_WATER = "18.010565::DOUBLE"


def _ions(of: str, heavy: bool = False) -> str:
    """Two selects of b and y ions (kind, n, fragment) of a column ``p`` of ``of``, whose other columns are kept."""
    extra = lambda part: f" + {_mass(part, chem.SILAC)}" if heavy else ""
    first, last = "p[1:n]", "p[len(p) - n + 1:]"
    return f"SELECT * EXCLUDE (n), n, 'b' AS kind, {_mass(first)}{extra(first)} AS fragment FROM (SELECT *, unnest(range(1, len(p))) AS n FROM {of}) UNION ALL SELECT * EXCLUDE (n), n, 'y', {_mass(last)}{extra(last)} + {_WATER} FROM (SELECT *, unnest(range(1, len(p))) AS n FROM {of})"


SQL = {
    "fragment_votes": f"""WITH {_CAND.format("abs((pmz - " + _PROTON + ") * 2 - mass) <= 500")}, {_MADE}, c AS (SELECT peptide AS p, mass FROM cand), i AS ({_ions("c")}), t AS (SELECT p, mass, fragment + {_PROTON} AS mz FROM i WHERE n > 2),
u AS (SELECT *, unnest([floor(mz / 0.1)::BIGINT - 1, floor(mz / 0.1)::BIGINT, floor(mz / 0.1)::BIGINT + 1]) AS b FROM t), s AS (SELECT run, pmz, pk, floor(pk / 0.1)::BIGINT AS b FROM peak JOIN sp USING (run))
SELECT run, p AS peptide, count(*) AS votes FROM s JOIN u USING (b) WHERE abs(pk - mz) <= mz * 20e-6 AND abs((pmz - {_PROTON}) * 2 - mass) <= 500 GROUP BY 1, 2""",
    "isotope_pairs": f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity + (l_linenumber % 5 - 1) * {_STEP} AS nm FROM lineitem), p AS (SELECT p_partkey, p_retailprice AS mass FROM part),
x AS (SELECT l_orderkey, p_partkey, nm, mass, greatest(-1, least(3, round((nm - mass) / {_STEP})))::INT AS k FROM m JOIN p ON mass BETWEEN nm - 3.1 AND nm + 1.1)
SELECT k AS isotope_error, count(*) AS n, count(DISTINCT p_partkey) AS parts, sum(l_orderkey)::BIGINT AS orders FROM x WHERE abs(nm - k * {_STEP} - mass) <= mass * 20e-6 GROUP BY 1""",
    "strongest_peaks": f"WITH {_S}, r AS (SELECT e.run, e.scan, mz, i, row_number() OVER (PARTITION BY e.run, e.scan ORDER BY i DESC, mz) AS k FROM e JOIN s ON s.run = e.run AND s.scan = e.scan WHERE ms_level = 2) SELECT run, scan, mz, i AS intensity FROM r WHERE k <= 3",
    "discriminant_scores": """WITH x AS (SELECT l_linestatus, l_returnflag = 'R' AS is_decoy, l_extendedprice AS a, l_quantity AS b FROM lineitem),
m AS (SELECT avg(a) FILTER (NOT is_decoy) AS ta, avg(b) FILTER (NOT is_decoy) AS tb, avg(a) FILTER (is_decoy) AS da, avg(b) FILTER (is_decoy) AS db, count(*) - 2 AS n FROM x),
c AS (SELECT sum((a - CASE WHEN is_decoy THEN da ELSE ta END) ^ 2) / any_value(n) AS aa, sum((b - CASE WHEN is_decoy THEN db ELSE tb END) ^ 2) / any_value(n) AS bb, sum((a - CASE WHEN is_decoy THEN da ELSE ta END) * (b - CASE WHEN is_decoy THEN db ELSE tb END)) / any_value(n) AS ab FROM x, m),
w AS (SELECT (bb * (ta - da) - ab * (tb - db)) / (aa * bb - ab * ab) AS wa, (aa * (tb - db) - ab * (ta - da)) / (aa * bb - ab * ab) AS wb, ta, tb, da, db FROM m, c),
s AS (SELECT l_linestatus, is_decoy, wa * (a - (ta + da) / 2) + wb * (b - (tb + db) / 2) AS s FROM x, w)
SELECT l_linestatus, is_decoy, count(*) AS n, round(avg(s), 7) AS mean, round(min(s), 7) AS least, round(max(s), 7) AS most, count(*) FILTER (s > 0) AS above FROM s GROUP BY 1, 2""",
    "picked_peptides": f"""WITH {_PEP}, t AS (SELECT peptide, reverse(peptide[1:len(peptide) - 1]) || right(peptide, 1) AS turned, floor({_mass("peptide")} / 7) AS score FROM pep),
d AS (SELECT peptide AS base, turned, score + CASE WHEN contains(peptide, 'P') THEN -1 ELSE 1 END * (len(peptide) % 3) AS ds FROM t),
w AS (SELECT peptide, t.score AS t, ds AS d, CASE WHEN ds > t.score THEN ds ELSE t.score END AS score, ds > t.score AS is_decoy FROM t JOIN d ON d.base = t.peptide), {q_sql("w").replace('f AS (', 'fd AS (').replace('FROM f)', 'FROM fd)')}
SELECT peptide, w.score, round(q_value, 9) AS q_value FROM w JOIN q ON q.score = w.score WHERE NOT is_decoy""",
    "peak_assignment": f"""WITH {_PEP}, c AS (SELECT peptide AS p FROM pep), i AS ({_ions("c")}), z AS (SELECT p, kind, n, z, (fragment + z * {_PROTON}) / z AS mz FROM i, (VALUES (1), (2)) AS v(z)),
k AS (SELECT p, (fragment + {_PROTON}) * (1 + 2e-6::DOUBLE) AS pk FROM i WHERE n % 2 = 0),
h AS (SELECT z.p, kind, n, z, mz, min(struct_pack(d := abs(pk - mz), pk := pk)) AS m FROM z JOIN k ON k.p = z.p AND abs(pk - mz) <= mz * 3000 * 1e-6 GROUP BY ALL),
a AS (SELECT p, m.pk AS pk, min(struct_pack(d := round(m.d, 9), kind := kind, n := n, z := z)) AS x FROM h GROUP BY ALL)
SELECT p AS peptide, count(*) AS peaks, count(*) FILTER (x.kind = 'y') AS y, sum(x.n)::BIGINT AS numbers, sum(x.z)::BIGINT AS charges FROM a GROUP BY 1""",
    "multi_target_trace": f"""WITH {_CAND.format("false")}, r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k, (mass + 2 * {_PROTON}) / 2 AS mz, {_mass("p", chem.SILAC)} AS shift FROM (SELECT DISTINCT peptide AS p, mass FROM cand WHERE NOT m.d)),
il AS ({_ions("(SELECT k, p FROM r)")}), ih AS ({_ions("(SELECT k, p FROM r)", True)}), tr AS (SELECT * FROM r WHERE k % 4 = 0),
f AS (SELECT tr.k AS t, o.k AS o, o.shift > 0 AS labelled, o.k / 10 - 2.5 AS start FROM tr JOIN r o ON o.k % 3 = tr.k % 3 AND o.k % 4 <> 0 AND o.p <> tr.p AND o.k / 10 - 2.5 <= tr.k / 10 + 2.5 AND tr.k / 10 - 2.5 <= o.k / 10 + 2.5 AND floor(o.mz / 100) = floor(tr.mz / 100)),
g AS (SELECT t, o, heavy, row_number() OVER (PARTITION BY t ORDER BY start, o, heavy) AS c FROM (SELECT t, o, start, unnest(CASE WHEN labelled THEN [false, true] ELSE [false] END) AS heavy FROM f) QUALIFY c <= 20),
own AS (SELECT t, count(*) AS candidates, bool_or(heavy) AS some_heavy FROM g GROUP BY 1),
th AS (SELECT t, false AS side, true AS trap, fragment FROM own JOIN il ON k = t UNION ALL SELECT t, true, true, fragment FROM own JOIN ih ON k = t UNION ALL SELECT t, unnest([false, true]), false, fragment FROM g JOIN il ON k = o AND NOT heavy UNION ALL SELECT t, unnest([false, true]), false, fragment FROM g JOIN ih ON k = o AND heavy),
tz AS (SELECT t, side, trap, (fragment + z * {_PROTON}) / z AS tm FROM th, (VALUES (1), (2)) AS v(z)),
pk AS (SELECT t, side, row_number() OVER () AS id, mz FROM (SELECT t, false AS side, fragment + {_PROTON} AS mz FROM own JOIN il ON k = t UNION ALL SELECT t, true, fragment + {_PROTON} FROM own JOIN ih ON k = t)),
cl AS (SELECT id, bool_or(trap) AS t, bool_or(NOT trap) AS o FROM pk JOIN tz ON tz.t = pk.t AND tz.side = pk.side AND abs(mz - tm) / tm * 1e6 <= 20 GROUP BY 1),
n AS (SELECT pk.t, pk.side, count(*) FILTER (cl.t AND NOT cl.o) AS a, count(*) FILTER (cl.o AND NOT cl.t) AS b, count(*) FILTER (cl.t AND cl.o) AS c, count(*) FILTER (cl.id IS NULL) AS d FROM pk LEFT JOIN cl USING (id) GROUP BY 1, 2),
h AS (SELECT own.t, (k + 1000000)::INT AS scan FROM own JOIN r ON k = own.t WHERE some_heavy AND shift > 0 AND floor((mz + shift / 2) / 100) <> floor(mz / 100))
SELECT l.t AS id, l.t::INT AS scan, candidates, l.a AS light_trap_only, l.b AS light_target_only, l.c AS light_shared, l.d AS light_unassigned, h.scan AS heavy_scan, CASE WHEN h.t IS NOT NULL THEN y.a END AS heavy_trap_only, CASE WHEN h.t IS NOT NULL THEN y.b END AS heavy_target_only,
CASE WHEN h.t IS NOT NULL THEN y.c END AS heavy_shared, CASE WHEN h.t IS NOT NULL THEN y.d END AS heavy_unassigned, round((l.c + CASE WHEN h.t IS NOT NULL THEN y.c ELSE 0 END)::DOUBLE / (l.a + l.b + l.c + l.d + CASE WHEN h.t IS NOT NULL THEN y.a + y.b + y.c + y.d ELSE 0 END), 6) AS shared_ratio
FROM n l JOIN own ON own.t = l.t JOIN n y ON y.t = l.t AND y.side LEFT JOIN h ON h.t = l.t WHERE NOT l.side""",
    "heavy_partners": f"""WITH {_CAND.format("false")}, r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k, (mass + 2 * {_PROTON}) / 2 AS mz, {_mass("p", chem.SILAC)} AS shift FROM (SELECT DISTINCT peptide AS p, mass FROM cand WHERE NOT m.d)),
s AS (SELECT k % 3 AS run, k::INT AS scan, k / 10 AS rt, floor(mz / 100) AS w FROM r UNION ALL SELECT k % 3, (k + 1000000)::INT, k / 10 + 0.001, floor((mz + shift / 2) / 100) FROM r),
x AS (SELECT k AS id, mz + shift / 2 AS hm, min(struct_pack(d := abs(s.rt - k / 10), rt := s.rt, scan := s.scan)).scan AS scan FROM r JOIN s ON s.run = k % 3 AND s.w = floor((mz + shift / 2) / 100) AND s.rt BETWEEN k / 10 - 0.5 AND k / 10 + 0.5 WHERE shift > 0 GROUP BY 1, 2)
SELECT id, scan, round(hm, 4) AS heavy_mz FROM x""",
    "observed_precursors": f"""WITH {_CAND.format("false")}, r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k, (mass + 2 * {_PROTON}) / 2 AS mz, {_mass("p", chem.SILAC)} AS shift FROM (SELECT DISTINCT peptide AS p, mass FROM cand WHERE NOT m.d)),
h AS (SELECT CASE WHEN k % 2 = 0 THEN k ELSE k - 3 END AS host, k, mz, mz + shift / 2 AS hm FROM r WHERE k % 2 = 0 OR (k >= 3 AND (k - 3) % 8 <> 2)),
pk AS (SELECT host, mz * (1 + 3e-6::DOUBLE) AS m, 10 AS i FROM h UNION ALL SELECT host, mz * (1 - 8e-6::DOUBLE), 20 FROM h WHERE k % 4 = 0 UNION ALL SELECT host, hm * (1 + 6e-6::DOUBLE), 5 FROM h),
n AS (SELECT k, arg_min(host, struct_pack(d := round(abs(k / 10 - host / 10 - 0.04), 6), host := host)) AS host FROM r JOIN (SELECT DISTINCT host FROM h) x ON host % 3 = k % 3 GROUP BY 1),
f AS (SELECT k, mz, CASE WHEN shift > 0 THEN mz + shift / 2 END AS hm, (SELECT arg_max(m, struct_pack(i := i, m := -m)) FROM pk WHERE pk.host = n.host AND abs(m - mz) <= mz * 20e-6) AS a, (SELECT arg_max(m, struct_pack(i := i, m := -m)) FROM pk WHERE pk.host = n.host AND shift > 0 AND abs(m - mz - shift / 2) <= (mz + shift / 2) * 20e-6) AS b FROM r LEFT JOIN n USING (k))
SELECT k AS id, a IS NOT NULL AS in_ms1, round((coalesce(a, mz) - mz) / mz * 1e6, 4) AS delta_ppm, round(hm, 4) AS heavy_mz, round((b - hm) / hm * 1e6, 4) AS heavy_delta_ppm FROM f""",
}
