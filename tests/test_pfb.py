"""PFB files of several partitions."""

import pytest
import theory
from pyspark.sql import functions as F

from massq.sources import pfb
from massq.sources import spectra as files


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    home = tmp_path_factory.mktemp("pfb")
    rows = [theory.spectrum("a", k + 1, p) for k, p in enumerate(["SAMPLEAGK", "LLGNVEELK", "AVDSLFTNR", "GGEELVDAK"] * 25)]
    (home / "a.pfb").write_bytes(theory.pfb(rows))
    (home / "b.PFB").write_bytes(theory.pfb(rows[:3][::-1]))
    (home / "none.pfb").write_bytes(theory.pfb([]))
    return home


def load(spark, path, split):
    pfb.register(spark)
    return spark.read.format("pfb").option("splitBytes", split).load(f"file://{path}")


def plain(path):
    return [(r["scan"], r["ms_level"], round(r["rt_min"], 9), len(r["precursors"]), tuple(r["mz"].tolist()), tuple(r["intensity"].tolist())) for r in files.parse_pfb(path.read_bytes())]


def rows_of(df):
    return [(r.scan, r.ms_level, round(r.rt_min, 9), len(r.precursors), tuple(r.mz), tuple(r.intensity)) for r in df.collect()]


@pytest.mark.parametrize("split", [1, 1000, 5000, 1 << 30])
def test_a_file_of_several_partitions(spark, made, split):
    df = load(spark, made / "a.pfb", split)
    n = df.rdd.getNumPartitions()
    assert n == (100 if split == 1 else 1 if split > 10_000_000 else n) and (split > 10_000 or n > 5)
    assert sorted(rows_of(df)) == sorted(plain(made / "a.pfb")) and {r.run for r in df.select("run").collect()} == {"a"}


def test_a_scan_is_looked_up_in_one_range(spark, made):
    df = load(spark, made / "a.pfb", 1000)
    one = df.where(F.col("scan") == 37)
    assert one.rdd.getNumPartitions() == 1 and rows_of(one) == [r for r in plain(made / "a.pfb") if r[0] == 37]
    some = df.where(F.col("scan").isin(1, 99, 100, 1000) & (F.col("ms_level") == 2))
    assert some.rdd.getNumPartitions() <= 3 and sorted(r[0] for r in rows_of(some)) == [1, 99, 100]
    assert df.where("scan = 1000").count() == 0


def test_scans_that_do_not_rise_are_all_looked_at(spark, made):
    df = load(spark, made / "b.PFB", 1)
    assert df.where("scan = 1").rdd.getNumPartitions() == 3 and df.where("scan = 1").count() == 1


def test_a_folder_and_the_reader(spark, made):
    assert files.read(spark, f"file://{made}/a.pfb").count() == 100 and load(spark, made, 1000).groupBy("run").count().count() == 2
    assert load(spark, made / "none.pfb", 1000).count() == 0


def test_what_is_no_pfb(spark, made, tmp_path):
    with pytest.raises(Exception, match="no file"):
        load(spark, tmp_path / "x.pfb", 10).count()
    (tmp_path / "bad.pfb").write_bytes(b"\0" * 30)
    with pytest.raises(Exception, match="doesn't fit"):
        load(spark, tmp_path / "bad.pfb", 10).count()
    with pytest.raises(pfb.SpectrumFormatError):
        pfb.opened("ftp://x/a.pfb")


def test_small_files_share_partitions(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"r{k}.pfb").write_bytes(theory.pfb([theory.spectrum("a", j + 1, "SAMPLEAGK") for j in range(k % 3)]))
    df = load(spark, tmp_path, 1 << 16)
    assert df.rdd.getNumPartitions() <= 200 < 300
    assert {(r.run, r.scan) for r in df.select("run", "scan").collect()} == {(f"r{k}", j + 1) for k in range(300) for j in range(k % 3)}
    assert df.where("scan = 2").count() == 100
