import io
import json

import pytest
import theory

from massq.operators import spectra as S
from massq.sources import proteins, results, sinks
from massq.sources import spectra as files

PEPTIDES = ["SAMPLEK", "PEPTIDER", "LLGNVLVK"]


@pytest.fixture(scope="module")
def made():
    return [theory.spectrum("r", i + 1, p) for i, p in enumerate(PEPTIDES)]


def _rows(df):
    return {r.scan: r for r in df.collect()}


def test_three_formats_agree(spark, tmp_path, made):
    (tmp_path / "r.mgf").write_text(theory.mgf(made))
    (tmp_path / "r.mzML").write_text(theory.mzml(made))
    (tmp_path / "r.pfb").write_bytes(theory.pfb(made))
    for name in ("r.mgf", "r.mzML", "r.pfb"):
        got = _rows(files.read(spark, f"file://{tmp_path}/{name}"))
        assert sorted(got) == [1, 2, 3]
        for want in made:
            x = got[want[1]]
            assert x.run == "r" and x.ms_level == 2 and abs(x.rt_min - want[3]) < 1e-9
            assert x.mz == pytest.approx(want[5]) and x.intensity == pytest.approx(want[6])
            assert x.precursors[0].mz == pytest.approx(want[4][0]["mz"]) and x.precursors[0].charge == 2
        if name != "r.mgf":
            assert got[1].precursors[0].isolation.lower == 1.0


def test_narrow_and_unpacked_arrays(spark, tmp_path, made):
    (tmp_path / "a.mzml").write_text(theory.mzml(made, "<f4", False))
    assert _rows(files.read(spark, f"file://{tmp_path}/a.mzml"))[2].mz == pytest.approx(made[1][5], rel=1e-6)


def test_mgf_without_end_scans_or_mass(spark, tmp_path, made):
    text = theory.mgf(made, close=False).replace("SCANS=", "X=")
    (tmp_path / "o.mgf").write_text(text + "BEGIN IONS\nTITLE=none\n1 2\nEND IONS\nBEGIN IONS\nPEPMASS=5\nCHARGE=3-\nbad line\n100 x\n100 7\nEND IONS\n")
    got = _rows(files.read_mgf(spark, f"file://{tmp_path}/o.mgf"))
    assert sorted(got) == [1, 2, 3, 4]
    assert got[4].precursors[0].charge == -3 and got[4].mz == [100.0] and got[4].precursors[0].intensity is None


def test_format_errors(spark, tmp_path):
    with pytest.raises(files.SpectrumFormatError):
        files.detect_format("x.raw")
    assert files.detect_format("a.MZML") == "mzml"
    with pytest.raises(files.SpectrumFormatError):
        list(files.parse_pfb(b"\0" * 30))


def test_ingest_and_look_up(spark, tmp_path, made):
    df = spark.createDataFrame(made, S.SCHEMA)
    stored = files.ingest(df, f"file://{tmp_path}/t")
    assert S.spectrum(stored, 2, "r").count() == 1
    with pytest.raises(LookupError):
        S.spectrum(stored, 99)
    plan = S.metadata(stored)._jdf.queryExecution().executedPlan().toString()
    assert "intensity" not in plan.split("ReadSchema")[1].split("precursors")[0]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|ONE_HUMAN first ->x\nacde\nFG\n>sp|P2|TWO\n\n>X three\nKK\n;note\n#note\nRR\n")
    path = f"file://{tmp_path}/a.fasta"
    got = {r.accession: r.sequence for r in proteins.read_fasta(spark, path).collect()}
    assert got["sp|P1|ONE_HUMAN"] == "ACDEFG" and "sp|P2|TWO" not in got
    kept = {r.accession: r.sequence for r in proteins.read_fasta(spark, path, upper=False, keep_empty=True, comments=True).collect()}
    assert kept == {"sp|P1|ONE_HUMAN": "acdeFG", "sp|P2|TWO": "", "X": "KKRR"}
    assert proteins.count_proteins(spark, path) == 3 and proteins.first_accessions(spark, path, 2) == ["sp|P1|ONE_HUMAN", "sp|P2|TWO"]
    assert {r.accession for r in proteins.fasta_accessions(spark, path).collect()} == {"sp|P1|ONE_HUMAN", "sp|P2|TWO", "X", "P1", "P2"}


def test_databases(spark, tmp_path):
    body = b">a\nKK\n>b\nRR\n"
    found = proteins.download("crap", str(tmp_path), lambda url: io.BytesIO(body))
    assert found["proteins"] == 2 and proteins.download("crap", str(tmp_path), None) == found
    assert {r.id: r.cached for r in proteins.databases(spark, str(tmp_path)).collect()}["crap"]
    assert proteins.organism_database("Human") == proteins.organism_database("9606") == "human_swissprot" and proteins.organism_database("zebra") is None


def test_diann(spark, tmp_path):
    rows = [("_AC(UniMod:4)M(UniMod:35)K_", 2, 500.0, 10.0, 0.001, "r1", "P1;P2", "ACMK", "P1"), ("AAK", 2, 400.0, 11.0, 0.5, "r1", None, "AAK", "P1"), ("CCK", 0, 400.0, 11.0, 0.0, "r2", None, "CCK", "P1")]
    names = ["Modified.Sequence", "Precursor.Charge", "Precursor.Mz", "RT", "Q.Value", "Run", "Protein.Names", "Stripped.Sequence", "Protein.Ids"]
    path = f"file://{tmp_path}/d.parquet"
    spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, ["string", "int", "double", "double", "double", "string", "string", "string", "string"]))).write.parquet(path)
    got = results.read_diann(spark, path).collect()
    assert [(r.peptide, r.accessions, round(r.score, 6)) for r in got] == [("ACMK", ["P1", "P2"], 0.999)]
    assert results.load_psms(spark, path).count() == 3
    with pytest.raises(results.ResultImportError):
        results.read_diann(spark.createDataFrame([(1,)], "a int").sparkSession, _other(spark, tmp_path))


def _other(spark, tmp_path):
    path = f"file://{tmp_path}/e.parquet"
    spark.createDataFrame([(1,)], "a int").write.parquet(path)
    return path


def test_pfind_generic_and_json(spark, tmp_path):
    header = "FileName\tPeptideSequence\tModifications\tPepMass\tPredRT\tCleavageType\tProNCTerm\tProteins\tMH+\tCharge\tScanNo\tRawScore\tDeltaMassPPM\tDeltaRT(Min)\tFinalScore\tQValue\n"
    (tmp_path / "p.tsv").write_text(header + "f\tACK\t2,Oxidation[M];\t1\tx\t3\t0\tP1/P2/\t1000.5\t2\t7\t1\t1\t0.1\t9.5\t0.001\nf\tAK\t\t1\t1\t3\t0\tP1\t10\t0\t7\t1\t1\t0.1\t9.5\t0.001\n")
    path = f"file://{tmp_path}/p.tsv"
    got = results.import_results(spark, path).collect()
    assert len(got) == 1 and got[0].rt_min == 0 and got[0].accessions == ["P1", "P2"] and got[0].precursor_mz == pytest.approx((1000.5 + 1.007276) / 2)
    loaded = results.load_psms(spark, path).collect()
    assert len(loaded) == 2 and loaded[0].protein_ids == "P1;P2" and loaded[0].rt_min is None
    (tmp_path / "g.tsv").write_text("seq\tcharge\nAAK\t2\n \t3\n")
    assert [(r.peptide, r.charge, r.q_value) for r in results.read_generic(spark, f"file://{tmp_path}/g.tsv", {"peptide": "seq"}).collect()] == [("AAK", 2, None)]
    (tmp_path / "j.json").write_text(json.dumps([{"sequence": "AAK", "charge": 2, "modify": [[1, 4]], "rt": 3.5, "precursor_mz": 300.1, "raw_title": "r"}]))
    assert results.import_results(spark, f"file://{tmp_path}/j.json").first().accessions == []
    (tmp_path / "s.spectra").write_text("x")
    with pytest.raises(NotImplementedError):
        results.import_results(spark, f"file://{tmp_path}/s.spectra")


def test_annotation_list_and_unimod(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("scan\tpeptide\tcharge\n3\tACK\t2\t1:57.02;2:1.5\n")
    x = results.read_annotations(spark, f"file://{tmp_path}/a.tsv").first()
    assert (x.scan, x.peptide, x.charge, [(m.pos, m.delta) for m in x.mods]) == (3, "ACK", 2, [(1, 57.02), (2, 1.5)])
    (tmp_path / "b.tsv").write_text("3\tACK\tx\n")
    with pytest.raises(Exception, match="not an annotation"):
        results.read_annotations(spark, f"file://{tmp_path}/b.tsv").collect()
    (tmp_path / "u.xml").write_text('<umod:unimod xmlns:umod="u"><umod:mod record_id="35" title="Oxidation"><umod:specificity site="M"/><umod:specificity site="N-term"/><umod:delta mono_mass="15.994915"/></umod:mod></umod:unimod>')
    assert [tuple(r) for r in results.unimod(spark, f"file://{tmp_path}/u.xml").collect()] == [(35, "Oxidation", 15.994915, "M")]
    assert results.unimod(spark).count() == 22


def test_config():
    c = results.read_config("version: 1\ntarget: [{contains: HUMAN}]\ntrap: [{regex: '_YEAST$'}]\nsimilarity: {delta_mz_threshold_da: 0.5}\n")
    assert c.target.contains == ("HUMAN",) and c.delta_mass == 0.5 and c.unmatched == "ignore"
    for bad in ("version: 2", "version: 1\ntarget: []\ntrap: []"):
        with pytest.raises(ValueError):
            results.read_config(bad)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A\tB", 2, 1.0, 2.0, 0.123, 5.0, None, ["p;1", "p2"], False, ["Ox"])], "scan int, peptide string, charge int, precursor_mz double, calculated_mz double, delta_ppm double, score double, q_value double, accessions array<string>, is_decoy boolean, modifications array<string>")
    sinks.write_tsv(sinks.psm_lines(rows), f"file://{tmp_path}/o", single=True)
    text = next((tmp_path / "o").glob("part-*")).read_text().splitlines()
    assert text[1].split("\t") == ["1", "A B", "2", "1.00000000", "2.00000000", "0.12", "5.000000", "NA", "p 1;p2", "false", "Ox"]
    for i in range(3):
        sinks.save_history({"status": "completed" if i else "failed", "timestamp": i, "psms": i}, str(tmp_path / "h"))
    (tmp_path / "h" / "bad.json").write_text("{nothing")
    assert [r.timestamp for r in sinks.load_history(spark, f"file://{tmp_path}/h", "comp").collect()] == [2, 1]
    page = sinks.page("<t>", rows.select("peptide"))
    assert "&lt;t&gt;" in page and "</script><script>" in page
    assert sinks.file_digests(spark, f"file://{tmp_path}/h/bad.json").first().sha256
