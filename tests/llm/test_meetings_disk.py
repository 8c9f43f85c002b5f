"""What the meetings of units shuffle when they are too many for a broadcast."""

from strideframe.llm import substring_dedup


def test_entries_and_places_are_filtered_before_they_are_shuffled(spark, monkeypatch):
    from tests_corpus import rows  # noqa: PLC0415

    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    columns = ["doc_id", "first_word", "end_word", "cluster", "keep_doc_id", "kept", "n_rows", "text_key"]
    members = lambda: sorted(map(tuple, substring_dedup.repeat_members(docs).select(*columns).collect()))
    few = members()
    plans, plain = {}, substring_dedup.settle

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, label)

    monkeypatch.setattr(substring_dedup, "settle", kept)
    monkeypatch.setattr(substring_dedup, "MOST_ROWS", 0)
    assert members() == few and any(m[0] != m[4] for m in few)
    assert "entries" not in plans and "Join" not in plans["nodes"] and "MapInArrow" in plans["nodes"]
    assert plans["clusters"].index("Join") < plans["clusters"].index("MapInArrow")  # below the join
