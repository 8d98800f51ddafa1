import pytest
import theory

from massq import api
from massq.operators import advice


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    peptides = ["SAMPLEAGK", "LLGNVEELK", "AVDSLFTNR", "GGEELVDAK"]
    (home / "a.mgf").write_text(theory.mgf([theory.spectrum("a", i + 1, p) for i, p in enumerate(peptides)]))
    (home / "a.mzML").write_text(theory.mzml([theory.spectrum("a", i + 1, p) for i, p in enumerate(peptides)]))
    (home / "wide.mzML").write_text(theory.mzml([theory.spectrum("a", i + 1, p, window=12.5) for i, p in enumerate(peptides)]))
    (home / "p.fasta").write_text("".join(f">P{i} x\n{p}\n" for i, p in enumerate(peptides)))
    return api.Session(spark, f"file://{home}/out"), f"file://{home}"


def test_search_from_file_to_export(session, tmp_path):
    s, d = session
    run = s.run_search(f"{d}/p.fasta", [f"{d}/a.mgf"], params=advice.Params(fixed=(), variable=()))
    assert s.get_search_status(run)["status"] == "completed", s.get_search_status(run)
    assert s.matches(run).count() >= 3 and s.generate_summary(run).first().psms >= 3
    assert s.diagnose_search(run).count() >= 0 and s.list_searches("comp")[0]["run_id"] == run
    s.export_results(run, f"file://{tmp_path}/x")
    assert list((tmp_path / "x" / "psm").glob("part-*"))
    with pytest.raises(api.NotFound):
        s.get_search_status("none")
    with pytest.raises(api.Unsupported):
        s.run_search(f"{d}/p.fasta", [f"{d}/wide.mzML"])
    failed = s.run_search(f"{d}/none.fasta", [f"{d}/a.mgf"], params=advice.Params())
    assert s.get_search_status(failed)["status"] == "failed"


def test_looking_at_spectra(session):
    s, d = session
    assert s.read_spectra(f"{d}/a.mzML").first().ms2 == 4 and s.get_spectrum(f"{d}/a.mzML", 2).count() == 1
    assert s.annotate_spectrum(f"{d}/a.mzML", 1, "SAMPLEAGK").where("type = 'b' and charge = 1 and not matched").count() == 0
    with pytest.raises(api.MassqError):
        s.annotate_spectrum(f"{d}/a.mzML", 1, "XX")
    batch = s.batch_annotate_spectra(f"{d}/a.mzML", s.spark.createDataFrame([(1, "SAMPLEAGK"), (99, "AAK")], "scan int, peptide string")).collect()
    assert {r.scan: r.score is None for r in batch} == {1: False, 99: True}
    x = s.extract_xic(f"{d}/a.mzML", 1, "SAMPLEAGK", heavy=True)
    assert x.where("intensity > 0").count() > 0 and x.where("label like '%*'").count() > 0
    assert s.annotate_provenance(f"{d}/a.mzML", 1, "SAMPLEAGK", "GGEELVDAK").first().trap_only > 0
    assert s.recommend_params(f"{d}/a.mzML").confidence > 0 and s.list_presets().count() == 5
    assert s.prepare_search(f"{d}/a.mzML", "yeast")["database"] == "yeast_swissprot"
    assert s.extract_spectrum_precursors(f"{d}/a.mzML", 1).count() == 0  # no MS1
    assert s.check_engine("x")[0]["available"] is False and "run_search" in api.catalogue()


def test_import_by_time(session, tmp_path):
    s, d = session
    rows = [("SAMPLEAGK", 2, theory.mz("SAMPLEAGK", 2), 1.2, 0.001, "a"), ("AAK", 2, 200.0, 1.2, 0.001, "a")]
    path = f"file://{tmp_path}/r.parquet"
    s.spark.createDataFrame(rows, "`Modified.Sequence` string, `Precursor.Charge` int, `Precursor.Mz` double, RT double, `Q.Value` double, Run string").write.parquet(path)
    got = s.import_search_results(path, f"{d}/a.mzML").collect()
    assert [(r.peptide, r.scan) for r in got] == [("SAMPLEAGK", 1)]
    with pytest.raises(api.NotFound):
        s.import_search_results(path, f"{d}/a.mzML", tolerance=0.01)


def test_entrapment(session, tmp_path):
    s, d = session
    (tmp_path / "t.fasta").write_text(">T1_HUMAN\nSAMPLEAGKLLGNVEELK\n>Y1_YEAST\nSAMPIEAGK\n")
    (tmp_path / "r.tsv").write_text("peptide\tprotein_ids\nSAMPIEAGK\tY1_YEAST\nLLGNVEELK\tT1_HUMAN\n")
    config = "version: 1\ntarget: [{contains: _HUMAN}]\ntrap: [{contains: _YEAST}]\n"
    got = {r.peptide: (r.group, r.level) for r in s.classify_entrapment_hits(f"file://{tmp_path}/r.tsv", config, f"file://{tmp_path}/t.fasta").collect()}
    assert got == {"SAMPIEAGK": ("trap", "L1"), "LLGNVEELK": ("target", "L4")}
    assert s.find_similar_targets("SAMPLEAGK", f"file://{tmp_path}/t.fasta").first().level == "L0"
