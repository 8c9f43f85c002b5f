"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns the columns of ``documents`` (the last one returns pieces).  The
tables that its result still reads are added to ``scratch``, where one is
given, for a caller that writes the result and deletes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.common import discard, fit_for_broadcast, settle
from strideframe.llm.jaccard_join import jaccard_components
from strideframe.llm.mixing import mix_sources
from strideframe.llm.packing import pack_documents
from strideframe.llm.quality_rules import quality_rules
from strideframe.llm.queries import tokenizer_path
from strideframe.llm.substring_dedup import find_repeats, remove_spans

MOST_BROADCAST = 1_000_000  # ids


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Documents that the quality rules reject go, and so do the lines above the limits in all others.

    Null and empty texts have no words and go; repeated rows and ties are
    judged alike; long texts are judged whole; an empty table stays empty;
    other columns pass unchanged, whatever their names; ``n_chars`` follows
    the text where lines went.
    """
    others = [c for c in docs.columns if c != "text"]
    renamed = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)])
    judged = quality_rules(renamed, payload=[f"_c{i}" for i in range(len(others))], left_col="_left", scratch=scratch).where("kept")
    now = {c: F.col(f"_c{i}") for i, c in enumerate(others)} | {"text": F.col("_left")}
    now["n_chars"] = F.when(F.col("n_line_words") > 0, F.length("_left").cast("bigint")).otherwise(now["n_chars"])
    return judged.select(*[now[c].alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Of documents joined by 5-word shingle similarity of 0.8 or more the one with the least (id, text hash) stays, once.

    Rows are told apart by id and text, so an id with several texts loses only
    those that are copies; of repeated rows one stays.  Null ids come after
    all others; null, empty and blank texts aren't similar to anything and
    stay.  Long texts are compared whole; an empty table stays empty; other
    columns pass unchanged, whatever their names.
    """
    done: list[DataFrame] = []
    groups = settle(jaccard_components(docs, shingle_words=5, percent=80, with_class=True, scratch=done).where(F.col("class").isNotNull()), "groups")
    discard(*done)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key")).alias("row")
    rows = settle(groups.groupBy("class", row).agg(F.count("*").alias("times")), "group-rows")
    stays = rows.groupBy("class").agg(F.min("row").alias("stays"))
    gone = rows.join(stays, "class").where(F.col("row") != F.col("stays")).select(F.col("row.id").alias("_i"), F.col("row.key").alias("_k"))
    gone = settle(gone, "gone")
    twice = rows.join(stays, "class").where((F.col("row") == F.col("stays")) & (F.col("times") > 1)).select(F.col("row.id").alias("_i"), F.col("row.key").alias("_k"))
    twice = settle(twice, "twice")
    discard(groups, rows)
    left_over = [gone, twice]
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"))
    same = F.col("d.doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64(F.col("d.text")) == F.col("_k"))
    left = whole.join(fit_for_broadcast(gone, MOST_BROADCAST), same, "left_anti")
    if not twice.isEmpty():
        twice = fit_for_broadcast(twice, MOST_BROADCAST)
        equal = settle(whole.join(twice, same).withColumn("at", F.monotonically_increasing_id()), "equal")
        first = settle(equal.groupBy("_i", "_k").agg(F.min("at").alias("at")).select("at"), "first")
        left_over += [equal, first]
        left = left.join(twice, same, "left_anti").union(equal.join(fit_for_broadcast(first, MOST_BROADCAST), "at", "left_semi").select("d"))
    if scratch is not None:
        scratch += left_over
    return left.select("d.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Passages that an earlier document keeps are cut; documents of nothing else go.

    Rows of one id are told apart by their text; of repeated rows one stays
    whole.  Null, empty and short texts pass, long ones are worked on whole, an
    empty table stays empty, other columns pass unchanged; ``n_chars`` follows
    the text.
    """
    done: list[DataFrame] = []
    left = remove_spans(docs, find_repeats(docs, scratch=done), drop_emptied=True, scratch=scratch)
    discard(*done)  # remove_spans has settled the spans
    return left.withColumn("n_chars", F.length("text").cast("bigint"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Sources in their target weights: a document comes as often as the mix takes it.

    Null and empty texts have size 0 and come as often as others of their
    source; null sources are one source; repeated rows and ties are taken
    alike; an empty table stays empty; other columns pass unchanged, whatever
    their names.
    """
    renamed = docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    mixed = mix_sources(renamed, payload=[f"_c{i}" for i in range(len(docs.columns))], scratch=scratch)
    mixed = mixed.select(*[F.col(f"_c{i}") for i in range(len(docs.columns))], F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.

    Null and empty texts are the end id alone; repeated rows are packed as
    often as they come; long texts are cut; other columns aren't read; an
    empty table gives no pieces.
    """
    return pack_documents(docs, tokenizer_path(), with_ids=False).drop("ids")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # the sum-of-squares packing has no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's result is written, and then its input and the tables it worked with are deleted, so that one copy of the corpus is kept at a time and the last stage's input is what stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        scratch: list[DataFrame] = []
        docs = settle(stage(spark, docs, sf_dir, scratch), name.replace(" ", "-"))
        discard(*before, *scratch)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
