"""The tools of the analysis as methods of one session: each is a short composition of operators.

Searches run in a Spark job group of their own, so their state can be asked for and
they can be cancelled. Results are Parquet tables under ``home``, which must be a
folder that the executors share; what a method returns as a frame stays distributed.
"""

from __future__ import annotations

import inspect
import time
import uuid
from dataclasses import asdict

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massq.functions import chem
from massq.functions import exprs as X
from massq.operators import advice, digest, entrapment, fdr, inference, joins, multitarget, occurrences, search, spectra
from massq.operators.shared import materialise, shared_path
from massq.sources import proteins as P
from massq.sources import results as R
from massq.sources import sinks
from massq.sources import spectra as files

#: Engines by name, with what each takes beside the parameters of a search. ``simple`` matches precursors, ``hyperscore`` looks fragments up in an index.
ENGINES: dict[str, dict] = {"simple": {}, "hyperscore": {}}


class MassqError(Exception):
    """An error with what to do about it."""

    suggestion = "see the message"

    def __init__(self, message: str, suggestion: str | None = None):
        super().__init__(message)
        self.suggestion = suggestion or self.suggestion


class NotFound(MassqError):
    suggestion = "check the name or run id"


class Unsupported(MassqError):
    suggestion = "extract precursors first, or choose another engine"


class Session:
    """``spark`` and a folder for runs, history and databases."""

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark, self.home = spark, home or shared_path(spark)
        self.runs: dict[str, dict] = {}
        self.extractions: dict[str, DataFrame] = {}

    # Spectra

    def spectra(self, *paths: str) -> DataFrame:
        return files.read_many(self.spark, list(paths))

    def read_spectra(self, path: str) -> DataFrame:
        return spectra.summary(self.spectra(path))

    def get_spectrum(self, path: str, scan: int) -> DataFrame:
        if scan < 1:
            raise MassqError("scan numbers start at 1")
        return spectra.spectrum(files.read_scan(self.spark, path, scan), scan)

    def find_by_time(self, rows: DataFrame, psms: DataFrame, tolerance: float = 0.5) -> DataFrame:
        """Matches (id, run, rt_min, precursor_mz) with the nearest MS2 scan whose window, if known, holds the m/z."""
        m = spectra.metadata(rows, 2).select(F.col("run").alias("_run"), "scan", F.col("rt_min").alias("scan_rt"), "isolation")
        holds = F.col("isolation").isNull() | X.window_contains(F.col("isolation.target"), F.col("isolation.lower"), F.col("isolation.upper"), F.col("precursor_mz"))
        return joins.nearest_join(psms, m, (("run", "_run"),), "rt_min", "scan_rt", tolerance, ["id"], ["scan_rt", "scan"], accept=holds)

    # Parameters

    def recommend_params(self, path: str, hints: dict | None = None) -> advice.Decision:
        first = self.read_spectra(path).first()
        if first is None:
            raise NotFound(f"no spectra in {path}")
        return advice.recommend(first.asDict(), hints)

    def list_presets(self) -> DataFrame:
        return advice.presets(self.spark)

    def prepare_search(self, path: str, organism: str, hints: dict | None = None) -> dict:
        database = P.organism_database(organism)
        if database is None:
            raise NotFound(f"no database for {organism}")
        decision = self.recommend_params(path, hints)
        return {"params": asdict(decision.params), "confidence": decision.confidence, "evidence": decision.evidence, "conflicts": decision.conflicts, "database": database}

    def check_engine(self, name: str | None = None) -> list[dict]:
        names = ENGINES if name is None else [name]
        return [{"engine": n, "available": n in ENGINES} for n in names]

    # Searches

    def run_search(self, fasta: str, paths: list[str] | None = None, extraction: str | None = None, params: advice.Params | None = None, engine: str = "simple", wait: bool = True) -> str:
        """Start a search over files or a kept extraction; the run's id. Files of wide windows are refused."""
        if engine not in ENGINES:
            raise Unsupported(f"no engine {engine}")
        if extraction is not None:
            if extraction not in self.extractions or params is None:
                raise NotFound("a kept extraction needs its id and parameters")
            rows = self.extractions.pop(extraction)
        else:
            rows = self.spectra(*(paths or []))
            mode = spectra.acquisition_mode(self.spectra(paths[0])).first()
            if mode is not None and mode["mode"] == "DIA":
                raise Unsupported("wide isolation windows")
            params = params or self.recommend_params(paths[0]).params
        run = uuid.uuid4().hex
        self.runs[run] = {"status": "running", "engine": engine, "params": params, "fasta": fasta, "started": time.time()}
        thread = InheritableThread(target=self._search, args=(run, rows, fasta, params, engine))
        thread.start()
        if wait:
            thread.join()
        return run

    def _search(self, run: str, rows: DataFrame, fasta: str, params: advice.Params, engine: str) -> None:
        state, group = self.runs[run], f"massq-{run}"
        try:
            self.spark.sparkContext.setJobGroup(group, "search", interruptOnCancel=True)
            found = search.search(rows, P.read_fasta(self.spark, fasta), params.precursor_tolerance, params.fragment_tolerance, params.fragment_unit, params.fixed, params.variable, params.max_mods, params.decoy, drop_decoys=False, precursor_unit=params.precursor_unit, enzyme=params.enzyme, missed=params.missed, shortest=params.shortest, longest=params.longest, engine=engine, **ENGINES[engine])
            found.write.parquet(f"{self.home}/runs/{run}")
            state["status"] = "cancelled" if state["status"] == "cancelled" else "completed"
        except Exception as x:  # noqa: BLE001  the state tells what became of the run
            if state["status"] != "cancelled":
                state |= {"status": "failed", "error": str(x)[:2000]}
        state["seconds"] = time.time() - state["started"]

    def get_search_status(self, run: str) -> dict:
        state = self._state(run)
        jobs = self.spark.sparkContext.statusTracker().getJobIdsForGroup(f"massq-{run}")
        return {"run_id": run, "status": state["status"], "jobs": len(jobs), "error": state.get("error")}

    def cancel_search(self, run: str) -> dict:
        state = self._state(run)
        if state["status"] == "running":
            state["status"] = "cancelled"
            self.spark.sparkContext.cancelJobGroup(f"massq-{run}")
        return self.get_search_status(run)

    def _state(self, run: str) -> dict:
        if run not in self.runs:
            raise NotFound(f"no run {run}")
        return self.runs[run]

    def matches(self, run: str, decoys: bool = False) -> DataFrame:
        if self._state(run)["status"] != "completed":
            raise NotFound(f"run {run} has no result")
        rows = self.spark.read.parquet(f"{self.home}/runs/{run}")
        return rows if decoys else rows.where("not is_decoy")

    def generate_summary(self, run: str) -> DataFrame:
        return search.summary(self.matches(run))

    def diagnose_search(self, run: str) -> DataFrame:
        """Decoys are counted before they leave; the time of a search is that of its matching, which writes the result."""
        state, rows = self._state(run), self.matches(run, decoys=True)
        s = rows.agg(F.count_if((F.col("q_value") <= 0.01) & ~F.col("is_decoy")).alias("psms"), F.count_if("is_decoy").alias("decoys"), F.avg(F.coalesce((F.col("q_value") <= 0.01).cast("double"), F.lit(0.0))).alias("id_rate"))
        tolerance = state["params"].precursor_tolerance
        return advice.diagnose(s.select("*", F.lit(tolerance).alias("tolerance_ppm"), F.lit(float(state.get("seconds", 0))).alias("matching_sec"), F.lit(float(state.get("seconds", 0))).alias("total_sec")))

    def export_results(self, run: str, out: str, fasta: str | None = None) -> None:
        """Tables and JSON; descriptions and coverage of proteins from the database: that of the search, unless another is given."""
        rows = self.matches(run)
        named = rows.withColumns({"accessions": F.array("accession"), "modifications": F.transform("combination", lambda s: s["mod"].cast("string"))})
        sinks.write_tsv(sinks.psm_lines(named), f"{out}/psm")
        sinks.write_tsv(sinks.peptide_lines(search.peptide_rollup(rows)), f"{out}/peptide")
        known = P.read_fasta(self.spark, fasta or self._state(run)["fasta"])
        own = rows.groupBy("accession").agg(F.collect_set("peptide").alias("peptides"))  # a protein's own peptides
        share = occurrences.coverage(own.join(known.select("accession", "sequence"), "accession"))
        proteins = search.protein_rollup(rows).join(known.select("accession", "description"), "accession", "left").join(share, "accession", "left")
        proteins = proteins.withColumns({"description": F.coalesce("description", F.lit("")), "coverage": F.coalesce(F.when(F.col("length") > 0, F.col("covered") / F.col("length")), F.lit(0.0))}).drop("covered", "length")
        sinks.write_tsv(sinks.protein_lines(proteins), f"{out}/protein")
        sinks.write_json(rows, f"{out}/json")

    def list_searches(self, status: str = "", limit: int = 20) -> list[dict]:
        rows = [{"run_id": r, **{k: v for k, v in s.items() if k != "params"}} for r, s in self.runs.items() if s["status"].startswith(status)]
        return sorted(rows, key=lambda r: -r["started"])[:limit]

    # Annotation and chromatograms

    def annotate_spectrum(self, path: str, scan: int, peptide: str, tolerance: float = 20.0, charge: int = 2, heavy: bool = False) -> DataFrame:
        """The peptide's ions in a scan; with ``heavy`` also those of its labelled form in the scan that shows it, if there is one, told apart by the scan."""
        if charge < 1 or not peptide or set(peptide) - set(chem.STANDARD):
            raise MassqError("a peptide of standard residues and a positive charge are needed")
        rows = self.get_spectrum(path, scan)
        of = rows.select("run", "scan", F.lit(peptide).alias("peptide"))
        found = spectra.annotate(rows, of, tolerance, 2 if charge >= 3 else 1)
        if not heavy:
            return found
        every = self.spectra(path)
        partner = multitarget.heavy_partners(every, of.select(F.lit(0).alias("id"), "run", "scan", "peptide", F.lit(charge).alias("charge"))).where("scan is not null")
        other = partner.select("scan").join(of.select("run", "peptide"))  # one row each
        return found.unionByName(spectra.annotate_heavy(every.join(other.select("run", "scan"), ["run", "scan"]), other, tolerance, 2 if charge >= 3 else 1))

    def batch_annotate_spectra(self, path: str, annotations: str | DataFrame, tolerance: float = 20.0) -> DataFrame:
        """Scores of a list of (scan, peptide, charge, mods), each for itself; those without a spectrum come back with no score.

        Modifications shift the ions from their place on; ions of two charges are looked for where the charge is 3 or more.
        With charges there are also ``observed_mz`` and ``delta_ppm`` of the precursor, by the peak that the MS1 nearest in time shows.
        """
        wanted = R.read_annotations(self.spark, annotations) if isinstance(annotations, str) else annotations
        wanted = materialise(wanted.withColumn("_a", F.monotonically_increasing_id()))
        every = self.spectra(path)
        rows = every.join(wanted.select("scan").distinct(), "scan", "left_semi")
        given = [c for c in ("charge", "mods") if c in wanted.columns]
        keyed = rows.select("run", "scan").join(wanted.select("_a", "scan", "peptide", *given), "scan")
        scores = spectra.annotation_scores(spectra.annotate(rows, keyed, tolerance, keys=("_a",)), rows, ("_a",))
        out = wanted.join(scores.drop("scan"), "_a", "left")
        if "charge" in given:
            own = keyed.select(F.struct("_a", "run").alias("id"), "run", "scan", "peptide", *given)  # a scan number may occur in several runs
            seen = spectra.observed_precursors(every, own).select(F.col("id._a").alias("_a"), F.col("id.run").alias("run"), "observed_mz", "delta_ppm")
            out = out.join(seen, ["_a", "run"], "left")
        return out.drop("_a")

    def extract_xic(self, path: str, scan: int, peptide: str, charge: int = 2, tolerance: float = 20.0, cycles: int = 5, rule: str = "max", top: int = 0, heavy: bool = False) -> DataFrame:
        """Chromatograms of a peptide's fragments in the scans of the same window round a scan, light and, if asked, heavy."""
        rows = self.spectra(path)
        target = spectra.spectrum(rows, scan).select("run", F.try_element_at("precursors", F.lit(1))["isolation"].alias("w"))
        ms2 = spectra.by_level(rows, 2).join(target, "run")  # one scan
        own = F.try_element_at("precursors", F.lit(1))["isolation"]
        same = F.col("w").isNull() | X.same_window(F.col("w.target"), F.col("w.lower") + F.col("w.upper"), own["target"], own["lower"] + own["upper"])
        near = spectra.cycles_around(ms2.where(F.coalesce(same, F.lit(False))), ("run",), F.col("scan") == scan, cycles)
        ions = target.select("run", F.explode(chem.theoretical_ions(F.lit(peptide), None, 2 if charge >= 3 else 1)).alias("i"), F.lit(peptide).alias("peptide")).select("run", F.col("i.label").alias("label"), F.col("i.mz").alias("ion_mz"), "peptide", "i.type", "i.number", "i.charge")
        if heavy:
            n = F.length("peptide")
            fragment = F.when(F.col("type") == "b", F.substring("peptide", F.lit(1), F.col("number"))).otherwise(F.substring(F.col("peptide"), n - F.col("number") + 1, F.col("number")))
            shifted = ions.withColumns({"ion_mz": F.col("ion_mz") + chem.heavy_delta(fragment) / F.col("charge"), "label": F.concat("label", F.lit("*"))})
            ions = ions.unionByName(shifted)
        traces = spectra.chromatograms(near, ions.select("run", "label", "ion_mz"), tolerance, rule)
        return spectra.top_traces(traces, top) if top else traces

    # Data-independent acquisition

    def extract_dia_precursors(self, path: str, output: str = "pseudo", extractor: str = "isotope", **settings) -> str:
        """Extract and keep; the extraction's id."""
        rows = spectra.EXTRACTORS[extractor](self.spectra(path), **settings)
        rows = spectra.pseudo_spectra(rows) if output == "pseudo" else rows
        name, out = uuid.uuid4().hex, f"{self.home}/extractions"
        rows.write.parquet(f"{out}/{name}")
        self.extractions[name] = self.spark.read.schema(rows.schema).parquet(f"{out}/{name}")
        return name

    def extract_spectrum_precursors(self, path: str, scan: int) -> DataFrame:
        """Precursors that isotope patterns show for one MS2 scan, and the MS1 they come from; other MS2 scans are left out first."""
        rows = materialise(self.spectra(path).where((F.col("ms_level") == 1) | (F.col("scan") == scan)))
        pair = spectra.correlate(rows)
        return spectra.extract_precursors(rows).select("run", "scan", "precursors").join(pair, ["run", "scan"])

    def get_dia_cache_status(self) -> list[dict]:
        return [{"id": k, "columns": v.columns} for k, v in self.extractions.items()]

    # Import and inference

    def import_search_results(self, path: str, spectra_path: str | None = None, q: float = 0.01, run: str | None = None, tolerance: float = 0.5) -> DataFrame:
        """Matches of another tool; those without a scan get the nearest in time and go if there is none."""
        rows = R.import_results(self.spark, path, q, run)
        if spectra_path is None:
            return rows
        keyed = rows.withColumn("id", F.xxhash64("run", "modified", "peptide", "charge", "rt_min", "precursor_mz"))
        found = self.find_by_time(self.spectra(spectra_path), keyed.where("scan is null").drop("scan"), tolerance).select("id", F.col("scan").alias("found"))
        out = keyed.join(found, "id", "left").withColumn("scan", F.coalesce("scan", "found")).where("scan is not null").drop("id", "found")
        if out.isEmpty():
            raise NotFound("no match has a scan in these spectra", "check the run names and the time unit")
        return out

    def infer_proteins(self, psms: DataFrame, fasta: str | None = None, q: float | None = 0.01) -> DataFrame:
        proteins = None if fasta is None else P.read_fasta(self.spark, fasta, upper=False, keep_empty=True, comments=True)
        groups = inference.infer(psms, proteins, q)
        try:
            picked = fdr.picked_q(groups).select("leader", "q_value")
        except fdr.FdrError:
            return groups.withColumn("q_value", F.lit(None).cast("double"))
        return groups.join(picked, "leader", "left")

    # Databases

    def list_databases(self, cache: str) -> DataFrame:
        return P.databases(self.spark, cache)

    def download_database(self, database: str, cache: str) -> dict:
        return P.download(database, cache)

    def get_database_info(self, database: str, cache: str) -> dict:
        row = P.databases(self.spark, cache).where(F.col("id") == database).first()
        if row is None:
            raise NotFound(f"no database {database}")
        info = row.asDict()
        return info | {"first": P.first_accessions(self.spark, f"file://{cache}/{database}.fasta") if info["cached"] else []}

    # Entrapment

    def classify_entrapment_hits(self, path: str, config: str, fasta: str) -> DataFrame:
        c = R.read_config(config)
        proteins = P.read_fasta(self.spark, fasta)
        targets = proteins.where(entrapment.group_of(F.col("accession"), c) == "target")
        return entrapment.classify(R.load_psms(self.spark, path), entrapment.target_index(targets, c), c)

    def analyze_entrapment_stats(self, classified: DataFrame) -> DataFrame:
        return entrapment.statistics(classified)

    def find_similar_targets(self, peptide: str, fasta: str, config: entrapment.Config | None = None) -> DataFrame:
        c = config or entrapment.Config(entrapment.Rule(regex="."), entrapment.Rule(regex="^$x"))
        one = self.spark.range(1).select(F.lit(peptide).alias("peptide"))
        return entrapment.classify_peptides(one, entrapment.target_index(P.read_fasta(self.spark, fasta), c), c)

    def annotate_provenance(self, path: str, scan: int, trap: str, target: str, tolerance: float = 20.0) -> DataFrame:
        rows = self.get_spectrum(path, scan)
        of = lambda p: spectra.annotate(rows, rows.select("run", "scan", F.lit(p).alias("peptide")), tolerance, 2, losses=False)
        return spectra.provenance(of(trap), of(target), rows)


def catalogue() -> str:
    """The tools with their parameters, as text."""
    out = []
    for name, f in inspect.getmembers(Session, inspect.isfunction):
        if not name.startswith("_"):
            out.append(f"{name}{inspect.signature(f)}" + (f"\n    {f.__doc__.splitlines()[0]}" if f.__doc__ else ""))
    return "\n".join(out)


__all__ = ["ENGINES", "MassqError", "NotFound", "Session", "Unsupported", "catalogue", "digest"]
