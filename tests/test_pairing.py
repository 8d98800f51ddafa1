"""Pairing of arriving scans: equal to the batch rule, however batches are cut, and across a restart."""

import random

import pytest
from pyspark.sql import functions as F

from massq.operators import spectra as S
from massq.plans import matching
from massq.streaming import events as streams
from massq.streaming import pairing

SF = "/root/testdata/sf0.001"
SCAN = "run string, scan int, ms_level int, rt_min double, source int"


def arrive(rows, folder, spark):
    spark.createDataFrame(rows, SCAN).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return pairing.paired(spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(folder))


@pytest.fixture(scope="module")
def scans(spark):
    rows = matching.scans(spark, SF)
    flat = rows.select("run", "scan", "ms_level", "rt_min", F.col("precursors")[0]["source_scan"].alias("source")).collect()
    want = sorted((tuple(r) for r in S.correlate(rows).select("run", "scan", "ms1_scan", "method").collect()), key=repr)
    return sorted(map(tuple, flat), key=lambda r: r[1]), want


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batches_give_what_the_whole_table_gives(spark, scans, tmp_path, seed):
    rows, want = scans
    rng = random.Random(seed)
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 3)), len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = rows[a:b]
        rng.shuffle(part)
        arrive(part, f"file://{tmp_path}/in", spark)
    arrive([(run, 0, 0, 0.0, None) for run in {r[0] for r in rows}], f"file://{tmp_path}/in", spark)
    got = streams.run_available(stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", "append")
    assert sorted((tuple(r) for r in got.select("run", "scan", "ms1_scan", "method").collect()), key=repr) == want


def test_state_survives_a_restart(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    arrive([("r", 1, 2, 0.1, None), ("r", 2, 1, 0.2, None), ("r", 3, 2, 0.3, 9), ("q", 1, 2, 0.1, None)], folder, spark)
    streams.run_available(stream(spark, folder), out, "append")
    arrive([("r", 4, 2, 0.4, 2), ("r", 5, 1, 0.5, None), ("r", 6, 2, 0.6, None), ("r", 7, 1, 0.1, None), ("r", 0, 0, 0.0, None), ("q", 0, 0, 0.0, None)], folder, spark)
    got = streams.run_available(stream(spark, folder), out, "append").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("r", 3, 2, "scan_order"), ("r", 4, 2, "source_scan"), ("r", 6, 5, "scan_order"), ("r", 1, 7, "nearest_rt"), ("q", 1, None, None)], key=repr)
