"""All pairs of subjects come from several tasks, in short periods; a null subject is one of them."""

from pathlib import Path

from strideframe.operators import splits


def test_pairs_are_dealt_in_tiles(spark, tmp_path):
    rows = spark.range(1200).selectExpr("if(id = 0, null, id * 7) as user_id")
    out = splits.loso_folds(rows.union(rows), "user_id")
    out.write.parquet(str(tmp_path / "pairs"))
    files = list(Path(tmp_path / "pairs").glob("*.parquet"))
    assert len(files) > 1 and sum(f.stat().st_size for f in files) < 500_000  # 1.8 MB in one file before
    got = spark.read.parquet(str(tmp_path / "pairs"))
    assert got.columns == ["held_out", "user_id", "split"] and got.count() == 1200**2 == got.distinct().count()
    assert got.where("split = 'held_out'").count() == 1199 == got.where("split = 'held_out' and held_out = user_id").count()


def test_no_row_becomes_more_than_a_pair_of_tiles(spark):
    """A join keeps all rows that it makes of one: numbers of tiles meet before a shuffle, subjects behind it."""
    out = splits.loso_folds(spark.range(1200).selectExpr("id as user_id"), "user_id")
    last = out._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[0]
    assert last.count("Generate explode") == 2 and "NestedLoop" not in last and "Cartesian" not in last
    assert out.count() == 1200**2 == out.distinct().count()
