"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import WS, fit_for_broadcast, lower_ascii, settle, words

_POS_BITS = 28  # positions of words; a text of over 2**28 words can't be held in one row of arrays
_POS = (1 << _POS_BITS) - 1


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Adds ``_rep``: the words of ``_ws`` inside 3-word windows found at least twice.

    Windows are packed as (35 bits of hash, position) into one long and sorted
    as primitives; those whose bits meet are then compared as text, so the
    count is exact.  Each step is a column, so that none is computed twice.
    """
    ws = F.col("_ws")
    gram = lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    top = lambda x: F.shiftright(x, _POS_BITS)
    beside = lambda a, i, of: F.coalesce(of(F.get(a, i)) == of(F.get(a, i - 1)), F.lit(False)) | F.coalesce(of(F.get(a, i)) == of(F.get(a, i + 1)), F.lit(False))
    docs = docs.withColumn(
        "_p",
        F.when(
            F.size(ws) >= 3,
            F.sort_array(
                F.slice(
                    F.transform(ws, lambda w, i: F.shiftleft(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).bitwiseAND(F.lit((1 << 35) - 1)), _POS_BITS).bitwiseOR(i.cast("long"))),
                    1, F.size(ws) - 2,
                )
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    docs = docs.withColumn("_p", F.filter("_p", lambda k, i: beside(F.col("_p"), i, top)))
    docs = docs.withColumn(
        "_g",
        F.sort_array(F.transform("_p", lambda k: F.struct(gram(k.bitwiseAND(F.lit(_POS)).cast("int")).alias("g"), k.bitwiseAND(F.lit(_POS)).alias("p")))),
    )
    docs = docs.withColumn("_g", F.filter("_g", lambda x, i: beside(F.col("_g"), i, lambda y: y["g"])))
    docs = docs.withColumn("_g", F.sort_array(F.transform("_g", lambda x: x["p"])))
    reach = F.transform("_g", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_g"), i + 1) - p, F.lit(3))))
    return docs.withColumn("_rep", F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_p", "_g")


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_line_docs: int = 20,
    max_line_percent: float = 5.0,
    min_left_percent: float = 30.0,
    max_broadcast_lines: int = 100_000,
    max_broadcast_rows: int = 1_000_000,
    payload: list[str] | None = None,
    left_col: str | None = None,
    scratch: list[DataFrame] | None = None,
) -> DataFrame:
    """One row per document with its figures and ``kept``.

    Base rules: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` percent of the words in repeated 3-word windows.
    Line rule: lines (A-Z lower-cased, words joined by one space) are counted
    over the distinct texts of each host; a line in at least ``min_line_docs``
    and more than ``max_line_percent`` percent of a host's distinct texts is
    removed there (see ``left_col``); a document with less than ``min_left_percent`` percent of
    its words left is rejected (``kept`` false).

    Copies of one text count once, so a document isn't rejected for having
    copies.  Null text is the empty text, null hosts form one host, an empty
    table gives an empty result, repeated rows are judged alike.  Columns
    named in ``payload`` are passed on; all others are ignored.

    ``left_col`` names a column for the text without the removed lines, each
    with one line end; a text without such lines, and a null one, is unchanged.
    Texts of any length are judged whole; null ids pass.  Tables that the
    result still reads are added to ``scratch``, for a caller that settles it
    and discards them.
    """
    text, host = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(host_col).cast("string")
    keep = payload or []
    rows = docs.select(
        F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("_d"),
        text.alias("_text"), host.alias("_host"),
        *([F.split(F.col(text_col).cast("string"), "\n", -1).alias("_all")] if left_col else []),
    )
    rows = rows.withColumn("_ws", words(F.col("_text")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    if left_col:
        worded = F.transform(F.split("_text", "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i))
        rows = rows.withColumn("_places", F.filter(worded, lambda i: i.isNotNull()))
    rows = _with_repeats(rows)
    rows = rows.select(
        "_d", "_host", "_rep", *(["_all", "_places"] if left_col else []),
        F.xxhash64("_text").alias("_fp"),
        F.size("_ws").cast("long").alias("_n"),
        F.length(F.regexp_replace("_text", WS, "")).cast("long").alias("_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("_sym"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dup"),
        F.transform("_lines", lambda x: F.trim(F.regexp_replace(lower_ascii(x), WS, " "))).alias("_lines"),
    ).withColumn("_lines", F.transform("_lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w"))))
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "quality")

    texts = rows.select("_host", "_fp", F.array_distinct(F.transform("_lines", lambda x: x["h"])).alias("_hs")).dropDuplicates(["_host", "_fp"])
    counts = texts.select("_host", F.explode("_hs").alias("_h")).groupBy("_host", "_h").agg(F.count("*").alias("_docs"))
    counts = counts.where(F.col("_docs") >= min_line_docs)
    hosts = rows.groupBy("_host").agg(F.countDistinct("_fp").alias("_all"))
    heavy = counts.alias("c").join(hosts.alias("h"), F.col("c._host").eqNullSafe(F.col("h._host")))
    heavy = settle(heavy.where(F.col("_docs") * 100.0 > F.col("_all") * max_line_percent).select(F.col("c._host").alias("_hh"), "_h"), "lines")

    lines = rows.select("_row", "_host", F.posexplode("_lines").alias("i", "l"))
    hit = lines.join(fit_for_broadcast(heavy, max_broadcast_lines), (F.col("l.h") == F.col("_h")) & F.col("_host").eqNullSafe(F.col("_hh")), "left_semi")
    places = [F.collect_list("i").alias("_at")] if left_col else []
    gone = settle(hit.groupBy(F.col("_row").alias("_r")).agg(F.sum("l.w").alias("_gone"), *places), "gone")
    if scratch is not None:
        scratch += [rows, heavy, gone]
    if not left_col:
        gone = fit_for_broadcast(gone, max_broadcast_rows)
    elif gone.select(F.explode("_at")).limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        gone = F.broadcast(gone)  # rows and places of lines are within the bound
    out = rows.drop("_lines").join(gone, F.col("_row") == F.col("_r"), "left")
    if left_col:
        off = F.transform("_at", lambda i: F.get(F.col("_places"), i))
        stay = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), off)
        out = out.withColumn("_left", F.array_join(F.when(F.col("_at").isNull(), F.col("_all")).otherwise(F.transform(stay, lambda i: F.get(F.col("_all"), i))), "\n"))
    failed = (F.col("_n") < min_words) | (100 * F.col("_rep") > max_repeat_percent * F.col("_n"))
    gone = F.coalesce("_gone", F.lit(0)).cast("long")
    depleted = (F.col("_n") - gone) * 100.0 < F.col("_n") * min_left_percent
    return out.select(
        F.col("_d.id").alias(id_col), *[F.col(f"_d.c{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_sym").alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"), F.col("_rep").alias("n_repeat_words"), gone.alias("n_line_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *([F.col("_left").alias(left_col)] if left_col else []),
    )
