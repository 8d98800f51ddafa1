"""In-silico digestion, decoys and modification sites."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massq.functions.chem import Modification, is_standard

#: Zero-width places between residues where an enzyme cleaves.
ENZYMES = {
    "trypsin": "(?<=[KR])(?!P)",
    "trypsin_p": "(?<=[KR])",
    "lysc": "(?<=K)",
    "gluc": "(?<=[DE])",
    "aspn": "(?=D)",
    "chymotrypsin": "(?<=[FWYL])",
}


def fragments(sequence: Column, enzyme: str) -> Column:
    """Pieces between cleavage sites; an unknown (custom) rule never cleaves."""
    if enzyme not in ENZYMES:
        return F.array(sequence)
    # Places have no width, so an empty piece could only be the last.
    return F.when(sequence == "", F.array().cast("array<string>")).otherwise(F.split(sequence, rf"(?:{ENZYMES[enzyme]})(?!\z)"))


def uncut(sequence: Column, enzyme: str, shortest: int = 7, longest: int = 50) -> Column:
    """Peptides without missed cleavages as an array, with the letters and lengths that ``digest`` lets through."""
    return F.filter(fragments(sequence, enzyme), lambda x: F.length(x).between(shortest, longest) & is_standard(x))


def digest(proteins: DataFrame, enzyme: str = "trypsin", missed: int = 2, shortest: int = 7, longest: int = 50, sequence: str = "sequence", keep: tuple[str, ...] = ("accession",)) -> DataFrame:
    """One row per peptide: ``keep``, ord (by missed cleavages, then place), peptide, terminal flags.

    Everything happens within a protein's row, so nothing shuffles. Peptides with other letters than the 20 go.
    """
    if enzyme == "nonspecific":
        n = F.length(sequence)
        starts = F.when(n >= shortest, F.sequence(F.lit(1), n - (shortest - 1))).otherwise(F.array().cast("array<int>"))
        rows = proteins.select(*keep, sequence, F.explode(starts).alias("_s"))
        rows = rows.select(*keep, sequence, "_s", F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(sequence) - F.col("_s") + 1))).alias("_n"))
        rows = rows.select(*keep, F.struct(F.col("_s").alias("missed"), F.col("_n").alias("place")).alias("ord"), F.substring(F.col(sequence), F.col("_s"), F.col("_n")).alias("peptide"), (F.col("_s") == 1).alias("is_protein_nterm"), (F.col("_s") + F.col("_n") - 1 == F.length(sequence)).alias("is_protein_cterm"))
        return rows.where(is_standard(F.col("peptide")))
    pieces = proteins.select(*keep, fragments(F.col(sequence), enzyme).alias("_f")).withColumn("_n", F.size("_f"))
    fits = lambda p: F.length(p).between(shortest, longest) & is_standard(p)
    if missed:
        # Pieces are joined before rows come of them: what is asked of a peptide, here or by a caller, doesn't join them again.
        spans = pieces.select("*", F.explode(F.sequence(F.lit(0), F.lit(missed))).alias("_m"))
        joined = lambda i: F.struct(i.alias("_i"), F.array_join(F.slice("_f", i, F.col("_m") + 1), "").alias("peptide"))
        every = F.transform(F.sequence(F.lit(1), F.col("_n") - F.col("_m")), joined)
        rows = spans.select(*keep, "_n", "_m", F.inline(F.when(F.col("_m") < F.col("_n"), F.filter(every, lambda p: fits(p["peptide"])))))
    else:
        rows = pieces.select(*keep, "_f", "_n", F.lit(0).alias("_m"), F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.col("_n")))).alias("_i"))
        rows = rows.select(*keep, "_n", "_m", "_i", F.get("_f", F.col("_i") - 1).alias("peptide")).where(fits(F.col("peptide")))
    return rows.select(*keep, F.struct(F.col("_m").alias("missed"), F.col("_i").alias("place")).alias("ord"), "peptide", (F.col("_i") == 1).alias("is_protein_nterm"), (F.col("_i") + F.col("_m") == F.col("_n")).alias("is_protein_cterm"))


def reverse_decoy(sequence: Column) -> Column:
    """All but the last residue reversed."""
    n = F.length(sequence)
    return F.concat(F.reverse(F.substring(sequence, F.lit(1), F.greatest(n - 1, F.lit(0)))), F.substring(sequence, F.greatest(n, F.lit(1)), F.lit(1)))


def shuffle_decoy(accession: Column, sequence: Column) -> Column:
    """All but the last residue in an order that a hash of accession and place sets: the same on any layout of the data."""
    n = F.length(sequence)
    places = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    keyed = F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(accession, i).alias("h"), F.substring(sequence, i, F.lit(1)).alias("c"))))
    return F.concat(F.array_join(F.transform(keyed, lambda x: x["c"]), ""), F.substring(sequence, F.greatest(n, F.lit(1)), F.lit(1)))


def decoys(proteins: DataFrame, strategy: str = "reverse") -> DataFrame:
    if strategy == "none":
        return proteins.limit(0)
    s = F.col("sequence")
    changed = reverse_decoy(s) if strategy == "reverse" else shuffle_decoy(F.col("accession"), s)
    prefix = {"reverse": "REV_", "shuffle": "SHUF_"}[strategy]
    return proteins.withColumns({"accession": F.concat(F.lit(prefix), "accession"), "sequence": changed})


def with_decoys(proteins: DataFrame, strategy: str = "reverse") -> DataFrame:
    """Targets, then decoys, told apart by ``is_decoy``."""
    return proteins.withColumn("is_decoy", F.lit(False)).unionByName(decoys(proteins, strategy).withColumn("is_decoy", F.lit(True)))


def sites(sequence: Column, mods: tuple[Modification, ...]) -> Column:
    """Where variable modifications may sit: array of (mod, pos), pos from 0, -1 and length for the ends."""
    n = F.length(sequence)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def of(k: int, m: Modification) -> Column:
        fits = lambda c: c.isin(*m.residues) if m.residues else F.lit(True)
        if m.position == "anywhere":
            return F.transform(F.filter(every, lambda i: fits(F.substring(sequence, i + 1, F.lit(1)))), lambda i: F.struct(F.lit(k).alias("mod"), i.alias("pos")))
        first = m.position.endswith("nterm")
        site = F.struct(F.lit(k).alias("mod"), (F.lit(-1) if first else n).alias("pos"))
        return F.when(fits(F.substring(sequence, 1 if first else -1, 1)), F.array(site)).otherwise(F.array().cast("array<struct<mod:int,pos:int>>"))

    return F.concat(*[of(k, m) for k, m in enumerate(mods)])


def site_combinations(found: Column, most: int) -> Column:
    """All sets of at most ``most`` sites at different positions, the empty one first."""
    empty = F.array(F.array().cast("array<struct<mod:int,pos:int>>"))

    def grow(sets: Column, site: Column) -> Column:
        free = F.filter(sets, lambda s: (F.size(s) < most) & ~F.exists(s, lambda x: x["pos"] == site["pos"]))
        return F.concat(sets, F.transform(free, lambda s: F.concat(s, F.array(site))))

    return F.aggregate(found, empty, grow)


def combination_deltas(combination: Column, length: Column, mods: tuple[Modification, ...]) -> Column:
    """Mass added at each position, from 0; terminal modifications count at the first or last one."""
    delta = F.create_map(*[x for k, m in enumerate(mods) for x in (F.lit(k), F.lit(m.delta))])
    places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda s: F.least(F.greatest(s["pos"], F.lit(0)), length - 1)
    return F.transform(places, lambda i: F.aggregate(F.filter(combination, lambda s: at(s) == i), F.lit(0.0), lambda t, s: t + F.element_at(delta, s["mod"])))


def n_combinations(n_sites: int, most: int) -> int:
    """How many sets of sites at different positions there are: for choosing ``most``."""
    return sum(1 for k in range(most + 1) for _ in combinations(range(n_sites), k))
