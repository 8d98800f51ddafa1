"""Protein databases: FASTA, accession lists, the registry of known databases."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str, upper: bool = True, keep_empty: bool = False, comments: bool = False) -> DataFrame:
    """accession (first token), description (the header), sequence. Records end where a line starts with ``>``, so files split.

    ``comments`` skips lines that start with # or ;. Entries without sequence go unless ``keep_empty``.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("v"), F.col("_metadata.file_path").alias("file"))
    lines = F.split("v", r"\r?\n")
    rest = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x)), lambda x: ~x.rlike("^[#;]") if comments else F.lit(True))
    header = F.trim(F.element_at(lines, 1))
    sequence = F.regexp_replace(F.array_join(rest, ""), r"\s+", "")
    out = rows.where(F.trim("v") != "").select(F.split_part(header, F.lit(" "), F.lit(1)).alias("accession"), header.alias("description"), (F.upper(sequence) if upper else sequence).alias("sequence"))
    return out if keep_empty else out.where("sequence <> ''")


def count_proteins(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def first_accessions(spark: SparkSession, path: str, n: int = 5) -> list[str]:
    return [r.accession for r in read_fasta(spark, path, keep_empty=True).select("accession").limit(n).collect()]


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list, without blanks and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("accession")).where((line != "") & ~line.startswith("#")).distinct()


def fasta_accessions(spark: SparkSession, path: str) -> DataFrame:
    """Full accessions and the bare ids inside ``sp|ID|NAME``."""
    from massq.functions.exprs import uniprot_id

    full = read_fasta(spark, path, keep_empty=True).select("accession")
    return full.union(full.select(uniprot_id(F.col("accession")).alias("accession")).where("accession is not null")).distinct()


#: Id, species, taxonomy id; reviewed proteomes by taxonomy id, and the contaminants list.
DATABASES = (
    ("human_swissprot", "Homo sapiens", 9606),
    ("mouse_swissprot", "Mus musculus", 10090),
    ("ecoli_swissprot", "Escherichia coli (K12)", 83333),
    ("yeast_swissprot", "Saccharomyces cerevisiae", 559292),
    ("arabidopsis_swissprot", "Arabidopsis thaliana", 3702),
    ("crap", "Contaminants", 0),
)
#: Names of organisms, and the place of their database above.
ORGANISMS = {"human": 0, "homo sapiens": 0, "人": 0, "mouse": 1, "mus musculus": 1, "小鼠": 1, "coli": 2, "大肠杆菌": 2, "yeast": 3, "saccharomyces": 3, "酵母": 3, "arabidopsis": 4, "拟南芥": 4, "contaminant": 5, "crap": 5}


def url_of(taxonomy: int) -> str:
    if not taxonomy:
        return "https://ftp.thegpm.org/fasta/cRAP/crap.fasta"
    return f"https://rest.uniprot.org/uniprotkb/stream?format=fasta&query=(reviewed:true)+AND+(model_organism:{taxonomy})"


def organism_database(organism: str) -> str | None:
    """By name, part of a name or taxonomy id."""
    text = organism.strip().lower()
    for name, _, taxonomy in DATABASES:
        if text == name or (taxonomy and text == str(taxonomy)):
            return name
    return next((DATABASES[k][0] for alias, k in ORGANISMS.items() if alias in text), None)


def databases(spark: SparkSession, cache: str) -> DataFrame:
    """The known databases and what the cache holds of them."""
    found = _registry(cache)
    rows = [(n, s, t, url_of(t), n in found, found.get(n, {}).get("proteins"), found.get(n, {}).get("sha256")) for n, s, t in DATABASES]
    return spark.createDataFrame(rows, "id string, species string, taxonomy_id int, url string, cached boolean, proteins long, sha256 string")


def _registry(cache: str) -> dict:
    path = Path(cache, "registry.json")
    return json.loads(path.read_text()) if path.exists() else {}


def download(database: str, cache: str, fetch=urllib.request.urlopen) -> dict:
    """Fetch a database into the cache (on the driver), unless it is there; the registry is replaced in one step."""
    entry = next((d for d in DATABASES if d[0] == database), None)
    if entry is None:
        raise KeyError(database)
    found, target = _registry(cache), Path(cache, f"{database}.fasta")
    if database in found and target.exists():
        return found[database]
    target.parent.mkdir(parents=True, exist_ok=True)
    digest, proteins, line_start = hashlib.sha256(), 0, True
    with fetch(url_of(entry[2])) as source, open(f"{target}.part", "wb") as out:
        while chunk := source.read(1 << 20):
            proteins += chunk.count(b"\n>") + (line_start and chunk[:1] == b">")
            line_start = chunk[-1:] == b"\n"
            digest.update(chunk)
            out.write(chunk)
    Path(f"{target}.part").replace(target)
    found[database] = {"path": str(target), "proteins": proteins, "sha256": digest.hexdigest()}
    part = Path(cache, "registry.json.part")
    part.write_text(json.dumps(found, indent=1))
    part.replace(Path(cache, "registry.json"))
    return found[database]
