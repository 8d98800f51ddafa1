"""Presets, recommended parameters and diagnostics: rules over one-row summaries."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massq.functions.chem import CARBAMIDOMETHYL, OXIDATION, Modification


@dataclass(frozen=True)
class Params:
    """Search parameters; wrong ones are refused at once."""

    precursor_tolerance: float = 10.0
    precursor_unit: str = "ppm"
    fragment_tolerance: float = 20.0
    fragment_unit: str = "ppm"
    enzyme: str = "trypsin"
    missed: int = 2
    shortest: int = 7
    longest: int = 50
    max_mods: int = 3
    fixed: tuple[Modification, ...] = (CARBAMIDOMETHYL,)
    variable: tuple[Modification, ...] = (OXIDATION,)
    decoy: str = "reverse"

    def __post_init__(self):
        for value in (self.precursor_tolerance, self.fragment_tolerance):
            if not 0 < value < float("inf"):
                raise ValueError("tolerances must be positive and finite")
        if not 0 <= self.missed <= 5 or not 0 <= self.max_mods <= 10 or not 1 <= self.shortest <= self.longest:
            raise ValueError("missed cleavages up to 5, modifications up to 10, lengths from 1 rising")


PHOSPHO = Modification("Phospho", 79.966331, "STY")
TMT_K, TMT_N = Modification("TMT6plex", 229.162932, "K"), Modification("TMT6plex", 229.162932, "", "peptide_nterm")
HEAVY_K, HEAVY_R = Modification("Label:13C(6)15N(2)", 8.014199, "K"), Modification("Label:13C(6)15N(4)", 10.008269, "R")
#: What users of the usual experiments expect.
PRESETS = {
    "standard": Params(),
    "phospho": Params(variable=(OXIDATION, PHOSPHO)),
    "tmt": Params(fixed=(CARBAMIDOMETHYL, TMT_K, TMT_N)),
    "silac": Params(variable=(OXIDATION, HEAVY_K, HEAVY_R)),
    "open_search": Params(precursor_tolerance=500.0, precursor_unit="Da"),
}


def presets(spark: SparkSession) -> DataFrame:
    rows = [(name, p.precursor_tolerance, p.precursor_unit, p.fragment_tolerance, p.missed, [m.name for m in p.fixed], [m.name for m in p.variable]) for name, p in PRESETS.items()]
    return spark.createDataFrame(rows, "name string, precursor_tolerance double, precursor_unit string, fragment_tolerance double, missed int, fixed array<string>, variable array<string>")


def merge_mods(a: tuple[Modification, ...], b: tuple[Modification, ...]) -> tuple[Modification, ...]:
    return a + tuple(m for m in b if m not in a)


def merged(a: Column, b: Column) -> Column:
    """Two arrays of modification structs as one: those of ``b`` that differ from all of ``a`` in any field are appended."""
    return F.array_union(a, b)


@dataclass
class Decision:
    params: Params
    confidence: float
    explanation: str
    evidence: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)


def recommend(summary: dict, hints: dict | None = None) -> Decision:
    """From a spectrum summary (mz_max, median_peaks, median_window) and hints (experiment, instrument, mods)."""
    hints = hints or {}
    name = hints.get("experiment", "standard")
    params, evidence, conflicts = PRESETS.get(name, PRESETS["standard"]), [], []
    dense, broad = (summary.get("median_peaks") or 0) >= 100, (summary.get("mz_max") or 0) >= 1500
    instrument = hints.get("instrument") or ("high_resolution" if dense or broad else "low_resolution" if summary.get("median_peaks") else "unknown")
    if instrument == "low_resolution" and name != "open_search":
        params = replace(params, precursor_tolerance=20.0, fragment_tolerance=0.1, fragment_unit="Da")
    elif instrument == "time_of_flight" and name != "open_search":
        params = replace(params, precursor_tolerance=15.0)
    evidence.append(f"instrument: {instrument}")
    if (summary.get("median_window") or 0) > 5:
        evidence.append("wide isolation windows: data-independent acquisition")
        if hints.get("acquisition") == "DDA":
            conflicts.append("the hint says DDA, the windows say DIA")
    if name not in PRESETS:
        conflicts.append(f"unknown experiment {name}")
    if hints.get("mods"):
        params = replace(params, variable=merge_mods(params.variable, tuple(hints["mods"])))
    confidence = min(1.0, max(0.1, 0.5 + 0.2 * bool(hints) + 0.2 * (instrument != "unknown") - 0.2 * len(conflicts)))
    return Decision(params, confidence, f"preset {name} for {instrument} data", evidence, conflicts)


def recommended(summaries: DataFrame) -> DataFrame:
    """``recommend`` without hints for every run of a table of summaries at once: (run, instrument, wide, precursor_tolerance, fragment_tolerance, fragment_unit, confidence)."""
    peaks, top = F.coalesce("median_peaks", F.lit(0)), F.coalesce("mz_max", F.lit(0.0))
    instrument = F.when((peaks >= 100) | (top >= 1500), "high_resolution").when(peaks > 0, "low_resolution").otherwise("unknown")
    low, p = F.col("instrument") == "low_resolution", PRESETS["standard"]
    rows = summaries.select("run", instrument.alias("instrument"), (F.coalesce("median_window", F.lit(0.0)) > 5).alias("wide"))
    return rows.withColumns({
        "precursor_tolerance": F.when(low, 20.0).otherwise(p.precursor_tolerance), "fragment_tolerance": F.when(low, 0.1).otherwise(p.fragment_tolerance),
        "fragment_unit": F.when(low, "Da").otherwise(p.fragment_unit), "confidence": F.when(F.col("instrument") == "unknown", 0.5).otherwise(0.7),
    })


#: Names, thresholds, priorities. name, condition over the summary row, priority, suggestion.
ANOMALIES = (
    ("NoPsms", "psms = 0", 1, "check the database and the tolerances"),
    ("NoDecoyHits", "decoys = 0", 1, "search with decoys"),
    ("VeryLowIdRate", "id_rate < 0.05", 2, "check modifications and the database"),
    ("LowIdRate", "id_rate >= 0.05 and id_rate < 0.10", 3, "widen the tolerance or add modifications"),
    ("FewPsms", "psms > 0 and psms < 50", 3, "use more spectra for q-values"),
    ("ToleranceTooTight", "tolerance_ppm < 5 and id_rate < 0.10", 4, "widen the precursor tolerance"),
    ("ToleranceTooWide", "tolerance_ppm > 50", 4, "narrow the precursor tolerance"),
    ("MatchingDominates", "matching_sec > 0.9 * total_sec and total_sec > 10", 5, "shrink the candidate space"),
)


def diagnose(summary: DataFrame) -> DataFrame:
    """Anomalies of each summary row (psms, decoys, id_rate, tolerance_ppm, matching_sec, total_sec), by priority."""
    found = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(p).alias("priority"), F.lit(name).alias("anomaly"), F.lit(s).alias("suggestion"))) for name, cond, p, s in ANOMALIES]))
    return summary.withColumn("_a", F.explode(F.array_sort(found))).select(*summary.columns, "_a.*")
