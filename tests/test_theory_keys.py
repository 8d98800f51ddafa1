from massq.plans import signals
from pyspark.sql import functions as F


def test_peptides_with_one_hash_stay_apart(spark, monkeypatch):
    letters = F.translate(F.lpad(F.col("id").cast("string"), 10, "0"), "0123456789", "AGVLIFWMST")
    peptides = spark.range(400_000).select(F.concat(letters, F.lit("K")).alias("p")).withColumn("h", F.abs(F.hash("p")))
    same = peptides.groupBy("h").agg(F.collect_list("p").alias("ps")).where("size(ps) > 1").limit(3).collect()
    found = [p for x in same for p in x.ps]
    assert len(found) >= 6
    monkeypatch.setattr(signals, "sequences", lambda spark, d: spark.createDataFrame([(p, p) for p in found], "accession string, sequence string"))
    assert sorted(x.peptide for x in signals.annotation(spark, "").collect()) == sorted(found)
    assert signals.annotation_scores(spark, "").count() == len(found)
