from collections import Counter

import corpus_pipeline as P
from strideframe.llm.common import settle


def test_stages_keep_columns_and_take_effect(spark):
    from tests_corpus import rows  # noqa: PLC0415

    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {}
    for name, stage in P.STAGES:
        out = settle(stage(spark, docs, ""), "test")
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = Counter(r.doc_id for r in out.collect())
        docs = out
    clean = set(range(20))
    assert 50 not in kept["quality rules"] and clean <= set(kept["quality rules"])
    assert clean | {30} <= set(kept["n-gram jaccard join"]) and not set(kept["n-gram jaccard join"]) & {31, 32, 33}
    assert set(kept["substring dedup"]) == set(kept["n-gram jaccard join"])
    assert set(kept["packing"]) == set(kept["mixing"]) and max(kept["mixing"].values()) <= 3


def test_quality_stage_passes_texts_without_heavy_lines(spark):
    body = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(i, f"Subscribe to our letter\n{body} d{i}", "en", "s", 5) for i in range(25)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.quality_stage(spark, docs, "").collect()}
    assert got == {i: (f"{body} d{i}", len(f"{body} d{i}")) for i in range(25)}


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_on_hard_rows(spark):
    """Shared ids, nulls, empties, a long text, repeated rows, and columns that stages use themselves."""
    from tests_corpus import rows  # noqa: PLC0415

    base = rows()
    a, b, c = base[0][1], base[1][1], base[2][1]
    hard = [(1, a), (5, a), (5, b), (None, b), (7, c), (7, c), (8, None), (9, ""), (10, " \n"), (11, " ".join(f"w{i}" for i in range(30_000))), (None, None)]
    names = "lang string, source string, n_chars bigint, _copy int, size string, kept string, n_words int, copies int, taken int, at int, d int, _i int"
    docs = spark.createDataFrame([(d, t, "en", None, len(t or ""), 1, "x", "y", 2, 3, 4, 5, 6, 7) for d, t in hard], f"doc_id bigint, text string, {names}")
    got = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got[name] = Counter((r.doc_id, r.text) for r in out.collect())
        assert all(tuple(r)[5:] == (1, "x", "y", 2, 3, 4, 5, 6, 7) for r in out.collect())
    assert got["quality rules"] == Counter(x for x in hard if len((x[1] or "").split()) >= 50)
    assert got["n-gram jaccard join"] == Counter({(1, a): 1, (5, b): 1, (7, c): 1, hard[9]: 1, (8, None): 1, (9, ""): 1, (10, " \n"): 1, (None, None): 1})
    assert got["substring dedup"] == got["n-gram jaccard join"]
    assert sum(got["mixing"].values()) and set(got["mixing"]) <= set(hard)
    assert P.packing_stage(spark, docs, "").select("doc_id").distinct().count() == 8


def test_run_keeps_only_the_last_stages_input(spark, tmp_path):
    from pathlib import Path

    from strideframe.llm.common import shared_dir
    from tests_corpus import rows  # noqa: PLC0415

    spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    pieces = P.run(spark, str(tmp_path))
    left = [p.name for p in set(folder.iterdir()) - before]
    assert len(left) == 1 and left[0].startswith("mixing-")
    assert pieces.count() > 0
