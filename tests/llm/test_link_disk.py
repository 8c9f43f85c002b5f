"""What the verification of candidate pairs shuffles."""

from pyspark.sql import functions as F

from strideframe.llm import jaccard_join


def test_only_sets_of_near_pairs_are_shuffled_whole(spark, monkeypatch):
    plans, plain = {}, jaccard_join.settle

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, label)

    monkeypatch.setattr(jaccard_join, "settle", kept)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("id") * 2 + i)
    sets = spark.range(50).select(F.col("id").alias("node"), F.lit(10).cast("long").alias("n"), tokens.alias("tokens"), F.array(F.lit(0)).alias("p2"), F.array(F.lit(0)).alias("p3"), F.array(F.lit(0).cast("long")).alias("sign"))
    pairs = spark.createDataFrame([(1, 2), (1, 30), (4, 5)], "a long, b long")
    links = jaccard_join._verified(pairs, plain(sets, "sets"), 60)
    assert sorted((r.a, r.b) for r in links.collect()) == [(1, 2), (4, 5)]
    assert plans["links"].count("LeftSemi") == 2
