"""Queries on digestion, chemistry and protein inference.

Texts stand in for protein sequences: their letters, upper case. For inference, parts
stand for peptides and orders for the proteins that hold them, over all of lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massq.functions import chem
from massq.functions import exprs as X
from massq.operators import digest as D
from massq.operators import inference as I
from massq.operators import occurrences as O
from massq.operators.shared import materialise
from massq.plans.matching import table


def sequences(spark, d: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return table(spark, d, name).select(F.col(key).cast("string").alias("accession"), letters.alias("sequence"))


def digest_trypsin(spark, d):
    return D.digest(sequences(spark, d), missed=0).groupBy("peptide").agg(F.count(F.lit(1)).alias("n"))


def digest_missed(spark, d):
    rows = D.digest(sequences(spark, d), missed=2)
    return rows.select("accession", F.col("ord.missed").alias("missed"), F.col("ord.place").alias("place"), "peptide", "is_protein_nterm", "is_protein_cterm")


def digest_enzymes(spark, d):
    enzymes = (*D.ENZYMES, "custom")
    sizes = {e: F.transform(D.uncut(F.col("sequence"), e, 1, 1 << 20), F.length) for e in enzymes}
    each = sequences(spark, d).select("accession", *[c.alias(e) for e, c in sizes.items()])  # one pass over the texts
    found = F.array(*[F.struct(F.lit(e).alias("enzyme"), F.size(e).cast("long").alias("n"), F.array_max(e).cast("long").alias("longest")) for e in enzymes])
    return each.select("accession", F.inline(found)).where("n > 0").groupBy("accession", "enzyme").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).select("accession", "n", "longest", "enzyme")


def digest_nonspecific(spark, d):
    return D.digest(sequences(spark, d, "benchmark", "item_id"), "nonspecific", shortest=7, longest=8).groupBy(F.length("peptide").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("distinct_n"))


def peptides(spark, d) -> DataFrame:
    return D.digest(sequences(spark, d), missed=0).select("peptide").distinct()


def peptide_masses(spark, d):
    p = F.col("peptide")
    mass = chem.peptide_mass(p)
    rows = peptides(spark, d).select(p, mass.alias("mass"))
    two, one = F.lit(2), F.lit(1)
    return rows.select("peptide", F.round("mass", 6).alias("mass"), F.round(chem.mz(F.col("mass"), two) + 1e-8, 4).alias("mz2"), F.round(chem.mh_to_mz(chem.mz(F.col("mass"), one), F.lit(3)) + 1e-8, 4).alias("mz3"), F.round(chem.heavy_mz(chem.mz(F.col("mass"), two), p, two) + 1e-8, 4).alias("heavy_mz2"))


def fixed_mod_masses(spark, d):
    mods = (chem.CARBAMIDOMETHYL, chem.Modification("TMT6plex", 229.162932, "K"), chem.Modification("TMT6plex", 229.162932, "", "peptide_nterm"))
    return peptides(spark, d).select("peptide", F.round(chem.fixed_mod_mass(F.col("peptide"), mods), 6).alias("added"))


def fragment_ions(spark, d):
    rows = peptides(spark, d).select("peptide", F.explode(chem.theoretical_ions(F.col("peptide"), None, 2)).alias("i"))
    return rows.select("peptide", "i.label", "i.number", "i.charge", F.round(F.col("i.mz") + 1e-8, 5).alias("mz"))


def neutral_losses(spark, d):
    rows = peptides(spark, d).select("peptide", F.explode(chem.theoretical_ions(F.col("peptide"), None, 1, losses=True)).alias("i"))
    return rows.groupBy("i.type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("i.mz"), 2).alias("sum_mz"))


def ion_ladders(spark, d):
    p = F.col("peptide")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda t, x: t + x) + 1e-8, 4)
    return peptides(spark, d).select(p, F.size(chem.b_ions(p, None, 2)).cast("long").alias("n"), total(chem.b_ions(p)).alias("b"), total(chem.y_ions(p)).alias("y"))


def decoy_database(spark, d):
    rows = D.with_decoys(sequences(spark, d), "reverse")
    return rows.select("accession", "sequence", "is_decoy")


def decoy_masses(spark, d):
    """A decoy peptide's mass is its target's: reversal inside the peptide keeps residues."""
    p = peptides(spark, d).select("peptide", D.reverse_decoy(F.col("peptide")).alias("decoy"))
    return p.select("peptide", "decoy", F.round(chem.peptide_mass(F.col("decoy")), 6).alias("mass"))


def shuffled_decoys(spark, d):
    s = sequences(spark, d, "benchmark", "item_id")
    rows = D.decoys(s, "shuffle")
    sort = lambda c: F.array_join(F.array_sort(X.letters(F.col(c))), "")
    return rows.select("accession", sort("sequence").alias("letters"), F.substring("sequence", -1, 1).alias("last"))


_MODS = (chem.OXIDATION, chem.Modification("Acetyl", 42.010565, "", "peptide_nterm"))


def mod_sites(spark, d):
    rows = peptides(spark, d).select("peptide", F.explode(D.sites(F.col("peptide"), _MODS)).alias("s"))
    return rows.select("peptide", "s.mod", "s.pos")


def mod_combinations(spark, d):
    mods = (chem.Modification("Phospho", 79.966331, "STY"),)
    rows = peptides(spark, d).withColumn("c", F.explode(D.site_combinations(D.sites(F.col("peptide"), mods), 2)))
    rows = rows.withColumn("deltas", D.combination_deltas(F.col("c"), F.length("peptide"), mods))
    return rows.groupBy("peptide").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate("deltas", F.lit(0.0), lambda t, x: t + x)), 4).alias("mass"))


def distinct_targets(spark, d):
    """Each peptide with the first protein that has it, and how many I/L forms it stands for."""
    rows = D.digest(sequences(spark, d).withColumn("accession", F.lpad("accession", 12, "0")), missed=0)
    first = rows.groupBy("peptide").agg(F.min("accession").alias("protein"))
    return first.groupBy(X.fold_il(F.col("peptide")).alias("folded")).agg(F.count(F.lit(1)).alias("forms"), F.min(F.struct("protein", "peptide"))["peptide"].alias("first_form"))


def _psms(spark, d) -> DataFrame:
    protein, peptide = (F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_orderkey", "l_partkey"))
    return table(spark, d, "lineitem").select(peptide.alias("peptide"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("q_value"), F.array(protein).alias("accessions"))


def _groups(spark, d) -> DataFrame:
    return materialise(I.indistinguishable(I.hits(_psms(spark, d), None)))


def bipartite_map(spark, d):
    return I.edges(_psms(spark, d), 0.05)


def _text(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(a, ";") for a in arrays})


def indistinguishable(spark, d):
    return _text(I.indistinguishable(I.hits(_psms(spark, d), None)), "peptides", "members").select("members", "peptides", "score")


def subset_links(spark, d):
    return I.subset_links(_groups(spark, d))


def without_subsets(spark, d):
    return _text(I.without_subsets(_groups(spark, d)), "peptides", "members").select("members", "peptides", "score")


def _named(spark, d) -> DataFrame:
    return I.without_subsets(_groups(spark, d)).withColumn("leader", F.element_at("members", 1))


def razor(spark, d):
    return I.razor(materialise(_named(spark, d)))


def sharing_counts(spark, d):
    each = _named(spark, d).select("leader", F.explode("peptides").alias("peptide"))
    return each.groupBy("peptide").agg(F.count(F.lit(1)).alias("groups"))


def parsimony(spark, d):
    """The greedy cover: no SQL; tests compare it with a plain version."""
    found = I.build_groups(I.parsimonious(I.without_subsets(_groups(spark, d))))
    return _text(I.in_order(found), "members", "peptides", "unique_peptides", "razor_peptides")


def infer_proteins(spark, d):
    """The whole inference over peptides of documents, with coverage of the document's sequence."""
    proteins = sequences(spark, d)
    found = D.digest(proteins, missed=0)  # a match has one protein: those of a common peptide needn't meet in a row
    psms = found.select("peptide", F.array("accession").alias("accessions"), (F.length("peptide") * 1.0).alias("score"), F.lit(0.001).alias("q_value"))
    found = I.infer(psms, proteins)
    return _text(found, "members", "peptides", "unique_peptides", "razor_peptides").withColumn("coverage", F.round("coverage", 6))


def sequence_coverage(spark, d):
    """Letters of each document's sequence under its own tryptic peptides, I as L, overlaps once."""
    s = sequences(spark, d)
    own = D.digest(s, missed=0).groupBy("accession").agg(F.collect_set("peptide").alias("peptides"))
    return O.coverage(s.join(own, "accession")).select("accession", "covered", F.col("length").alias("len"))


def decoy_predicate(spark, d):
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "REV_", "SHUF_", "DECOY_", "REVERSED_", "rev_", "X_REV_")]), (F.col("c_custkey") % 7 + 1).cast("int")), F.col("c_name"))
    return table(spark, d, "customer").groupBy(X.is_decoy(name).alias("is_decoy"), chem.is_standard(F.upper(F.substring("c_mktsegment", 1, 4))).alias("standard")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (digest_trypsin, digest_missed, digest_enzymes, digest_nonspecific, peptide_masses, fixed_mod_masses, fragment_ions, neutral_losses, ion_ladders, decoy_database, decoy_masses, shuffled_decoys, mod_sites, mod_combinations, distinct_targets, bipartite_map, indistinguishable, subset_links, without_subsets, razor, sharing_counts, parsimony, infer_proteins, sequence_coverage, decoy_predicate)}

_STD = "[GAVLIPFWMSTCYHDENQKR]*"


def _mass(c: str, extra: dict[str, float] | None = None) -> str:
    """Sum of residue masses of a string by counting letters."""
    return "(" + " + ".join(f"(len({c}) - len(replace({c}, '{k}', ''))) * {v}::DOUBLE" for k, v in (extra or chem.RESIDUES).items()) + ")"


_BENCH = "seq AS (SELECT item_id::VARCHAR AS accession, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM benchmark)"
_SEQ = "seq AS (SELECT doc_id::VARCHAR AS accession, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents)"


def _split(rule: str, change: str) -> str:
    once = f"regexp_replace(s, '{rule}', '{change}', 'g')"
    return f"list_filter(string_split(regexp_replace({once}, '{rule}', '{change}', 'g'), ';'), lambda x: x <> '')"


_TRYPSIN = _split("([KR])([^P;])", "\\1;\\2")
_PEP = f"{_SEQ}, f AS (SELECT accession, {_TRYPSIN} AS f FROM seq), pep AS (SELECT DISTINCT p AS peptide FROM (SELECT unnest(f) AS p FROM f) WHERE len(p) BETWEEN 7 AND 50 AND regexp_full_match(p, '{_STD}'))"
_RULES = {"trypsin": ("([KR])([^P;])", "\\1;\\2"), "trypsin_p": ("([KR])([^;])", "\\1;\\2"), "lysc": ("(K)([^;])", "\\1;\\2"), "gluc": ("([DE])([^;])", "\\1;\\2"), "aspn": ("([^;])(D)", "\\1;\\2"), "chymotrypsin": ("([FWYL])([^;])", "\\1;\\2")}
_PARTS = " UNION ALL ".join(f"SELECT '{e}' AS enzyme, accession, unnest({_split(*r)}) AS p FROM seq" for e, r in _RULES.items()) + " UNION ALL SELECT 'custom', accession, s FROM seq"
_EDGES = "e AS (SELECT lpad(l_partkey::VARCHAR, 9, '0') AS peptide, lpad(l_orderkey::VARCHAR, 9, '0') AS protein, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)"
_GROUPS = f"{_EDGES}, ps AS (SELECT protein, list_sort(list(peptide)) AS peptides, max(score) AS score FROM e GROUP BY 1), g AS (SELECT peptides, list_sort(list(protein)) AS members, max(score) AS score, min(protein) AS first, len(peptides) AS size FROM ps GROUP BY peptides)"
_LINKS = f"{_GROUPS}, ge AS (SELECT first, size, unnest(peptides) AS p FROM g), met AS (SELECT a.first AS sub, a.size AS n, b.first AS super, b.size AS m, count(*) AS shared FROM ge a JOIN ge b ON a.p = b.p AND a.size < b.size GROUP BY ALL), lk AS (SELECT sub, arg_min(super, struct_pack(x := -m, y := super)) AS super FROM met WHERE shared = n GROUP BY 1)"
_KEPT = f"{_LINKS}, gain AS (SELECT super, flatten(list(members)) AS gained FROM g JOIN lk ON first = sub GROUP BY 1), kept AS (SELECT list_sort(list_distinct(list_concat(members, coalesce(gained, [])))) AS members, peptides, score FROM g LEFT JOIN gain ON first = super WHERE first NOT IN (SELECT sub FROM lk)), n AS (SELECT *, members[1] AS leader FROM kept), x AS (SELECT leader, score, unnest(peptides) AS peptide FROM n), sh AS (SELECT peptide, count(*) AS groups FROM x GROUP BY 1)"
SQL = {
    "digest_trypsin": f"WITH {_SEQ}, p AS (SELECT unnest({_TRYPSIN}) AS peptide FROM seq) SELECT peptide, count(*) AS n FROM p WHERE len(peptide) BETWEEN 7 AND 50 AND regexp_full_match(peptide, '{_STD}') GROUP BY 1",
    "digest_missed": f"""WITH {_SEQ}, f AS (SELECT accession, {_TRYPSIN} AS f FROM seq), m AS (SELECT accession, f, unnest(range(0, least(3, len(f)))) AS missed FROM f), i AS (SELECT *, unnest(range(1, len(f) - missed + 1)) AS place FROM m),
r AS (SELECT accession, missed::INT AS missed, place::INT AS place, array_to_string(f[place:place + missed], '') AS peptide, place = 1 AS is_protein_nterm, place + missed = len(f) AS is_protein_cterm FROM i) SELECT * FROM r WHERE len(peptide) BETWEEN 7 AND 50 AND regexp_full_match(peptide, '{_STD}')""",
    "digest_enzymes": f"WITH {_SEQ}, p AS ({_PARTS}) SELECT enzyme, accession, count(*) AS n, max(len(p)) AS longest FROM p WHERE p <> '' AND regexp_full_match(p, '{_STD}') GROUP BY 1, 2",
    "digest_nonspecific": f"""WITH {_BENCH}, i AS (SELECT s, k, unnest(range(1, len(s) - k + 2)) AS a FROM seq, (VALUES (7), (8)) AS l(k)), p AS (SELECT k, s[a:a + k - 1] AS p FROM i) SELECT k::BIGINT AS len, count(*) AS n, count(DISTINCT p) AS distinct_n FROM p WHERE regexp_full_match(p, '{_STD}') GROUP BY 1""",
    "peptide_masses": f"""WITH {_PEP}, m AS (SELECT peptide, {_mass("peptide")} + 18.010565 AS mass FROM pep) SELECT peptide, round(mass, 6) AS mass, round((mass + 2 * 1.007276) / 2 + 1e-8, 4) AS mz2, round((mass + 1.007276 + 2 * 1.007276) / 3 + 1e-8, 4) AS mz3,
round((mass + 2 * 1.007276) / 2 + {_mass("peptide", chem.SILAC)} / 2 + 1e-8, 4) AS heavy_mz2 FROM m""",
    "fixed_mod_masses": f"WITH {_PEP} SELECT peptide, round({_mass('peptide', {'C': 57.021464, 'K': 229.162932})} + 229.162932, 6) AS added FROM pep",
    "fragment_ions": f"""WITH {_PEP}, i AS (SELECT peptide, unnest(range(1, len(peptide))) AS n FROM pep), m AS (SELECT peptide, n, {_mass("peptide[1:n]")} AS b, {_mass("peptide[len(peptide) - n + 1:]")} + 18.010565 AS y FROM i),
z AS (SELECT *, unnest([1, 2]) AS z FROM m) SELECT peptide, 'b' || n || '+' || z AS label, n::INT AS number, z::INT AS charge, round((b + z * 1.007276) / z + 1e-8, 5) AS mz FROM z UNION ALL SELECT peptide, 'y' || n || '+' || z, n::INT, z::INT, round((y + z * 1.007276) / z + 1e-8, 5) FROM z""",
    "neutral_losses": f"""WITH {_PEP}, i AS (SELECT peptide, unnest(range(1, len(peptide))) AS n FROM pep), m AS (SELECT {_mass("peptide[1:n]")} AS b, {_mass("peptide[len(peptide) - n + 1:]")} + 18.010565 AS y FROM i),
l(name, d) AS (VALUES ('', 0.0), ('-H2O', 18.010565), ('-NH3', 17.026549)), a AS (SELECT 'b' || name AS type, b - d + 1.007276 AS mz FROM m, l UNION ALL SELECT 'y' || name, y - d + 1.007276 FROM m, l) SELECT type, count(*) AS n, round(sum(mz), 2) AS sum_mz FROM a GROUP BY 1""",
    "ion_ladders": f"""WITH {_PEP}, i AS (SELECT peptide, unnest(range(1, len(peptide))) AS n FROM pep) SELECT peptide, count(*) * 2 AS n, round(sum({_mass("peptide[1:n]")} + 1.007276) + 1e-8, 4) AS b, round(sum({_mass("peptide[len(peptide) - n + 1:]")} + 18.010565 + 1.007276) + 1e-8, 4) AS y FROM i GROUP BY 1""",
    "decoy_database": f"WITH {_SEQ} SELECT accession, s AS sequence, false AS is_decoy FROM seq UNION ALL SELECT 'REV_' || accession, reverse(s[1:len(s) - 1]) || s[len(s):], true FROM seq",
    "decoy_masses": f"WITH {_PEP} SELECT peptide, reverse(peptide[1:len(peptide) - 1]) || right(peptide, 1) AS decoy, round({_mass('peptide')} + 18.010565, 6) AS mass FROM pep",
    "shuffled_decoys": f"WITH {_BENCH} SELECT 'SHUF_' || accession AS accession, array_to_string(list_sort(string_split(s, '')), '') AS letters, right(s, 1) AS last FROM seq",
    "mod_sites": f"WITH {_PEP}, i AS (SELECT peptide, unnest(range(1, len(peptide) + 1)) AS n FROM pep) SELECT peptide, 0 AS mod, (n - 1)::INT AS pos FROM i WHERE peptide[n] = 'M' UNION ALL SELECT peptide, 1, -1 FROM pep",
    "mod_combinations": f"WITH {_PEP}, c AS (SELECT peptide, len(peptide) - len(regexp_replace(peptide, '[STY]', '', 'g')) AS n FROM pep) SELECT peptide, 1 + n + n * (n - 1) // 2 AS n, round((n + n * (n - 1)) * 79.966331, 4) AS mass FROM c",
    "distinct_targets": f"""WITH {_SEQ}, p AS (SELECT lpad(accession, 12, '0') AS a, unnest({_TRYPSIN}) AS peptide FROM seq), q AS (SELECT peptide, min(a) AS protein FROM p WHERE len(peptide) BETWEEN 7 AND 50 AND regexp_full_match(peptide, '{_STD}') GROUP BY 1)
SELECT translate(peptide, 'I', 'L') AS folded, count(*) AS forms, min(struct_pack(protein := protein, peptide := peptide)).peptide AS first_form FROM q GROUP BY 1""",
    "bipartite_map": "SELECT lpad(l_partkey::VARCHAR, 9, '0') AS peptide, lpad(l_orderkey::VARCHAR, 9, '0') AS protein, max(l_extendedprice) AS score FROM lineitem WHERE l_tax <= 0 OR l_discount <= 0.05 GROUP BY 1, 2",
    "indistinguishable": f"WITH {_GROUPS} SELECT array_to_string(members, ';') AS members, array_to_string(peptides, ';') AS peptides, score FROM g",
    "subset_links": f"WITH {_LINKS} SELECT sub, super FROM lk",
    "without_subsets": f"WITH {_KEPT} SELECT array_to_string(members, ';') AS members, array_to_string(peptides, ';') AS peptides, score FROM kept",
    "sharing_counts": f"WITH {_KEPT} SELECT peptide, groups FROM sh",
    "razor": f"""WITH {_KEPT}, u AS (SELECT leader, count(*) FILTER (groups = 1) AS nu FROM x JOIN sh USING (peptide) GROUP BY 1)
SELECT peptide, leader FROM (SELECT x.peptide, x.leader, row_number() OVER (PARTITION BY x.peptide ORDER BY nu DESC, score DESC, x.leader) AS r FROM x JOIN sh USING (peptide) JOIN u ON u.leader = x.leader WHERE groups > 1) WHERE r = 1""",
    "sequence_coverage": f"""WITH {_SEQ}, q AS (SELECT accession, translate(s, 'I', 'L') AS s, list_distinct(list_transform(list_filter({_TRYPSIN}, lambda x: len(x) BETWEEN 7 AND 50 AND regexp_full_match(x, '{_STD}')), lambda x: translate(x, 'I', 'L'))) AS ps FROM seq),
o AS (SELECT accession, p, p[1:7] AS k FROM (SELECT accession, unnest(ps) AS p FROM q)), w AS (SELECT accession, a, s[a:a + 6] AS k FROM (SELECT accession, s, unnest(range(1, len(s) - 5)) AS a FROM q)),
i AS (SELECT accession, a, a + len(p) AS b FROM w JOIN o USING (accession, k) JOIN q USING (accession) WHERE s[a:a + len(p) - 1] = p),
g AS (SELECT accession, greatest(0, b - greatest(a, coalesce(max(b) OVER (PARTITION BY accession ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM i)
SELECT q.accession, sum(n)::BIGINT AS covered, len(q.s) AS len FROM q JOIN g USING (accession) GROUP BY q.accession, q.s""",
    "decoy_predicate": "WITH c AS (SELECT CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'REV_' WHEN 2 THEN 'SHUF_' WHEN 3 THEN 'DECOY_' WHEN 4 THEN 'REVERSED_' WHEN 5 THEN 'rev_' ELSE 'X_REV_' END || c_name AS n, upper(c_mktsegment[1:4]) AS s FROM customer) SELECT regexp_matches(n, '^(REV_|SHUF_|DECOY_|REVERSED_)') AS is_decoy, regexp_full_match(s, '[GAVLIPFWMSTCYHDENQKR]*') AS standard, count(*) AS n FROM c GROUP BY 1, 2",
}
