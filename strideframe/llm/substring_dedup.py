"""Passages that repeat across documents, by MinHash banding of paragraphs."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.common import WordHashes, discard, fit_for_broadcast, mix64, sequence_hashes, settle, shingles, text_blocks
from strideframe.llm.jaccard_join import bloom_of, let_through, link_entries, paired

SIGN_WORDS = 4
WIDE_WORDS = 32  # of a second signature, which sets of more than WIDE_FROM shingles have
WIDE_FROM = 64
SPREAD = 16  # of so many neighbouring words, a window starts at one
MEMO = 200_000  # texts and units that a task remembers to have sent on
MOST_ROWS = 1_000_000  # of narrow rows; a quarter of it is broadcast at most
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tune_bands(similarity: float, recall: float, max_bands: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose collision chance at ``similarity`` is at least ``recall`` with ``max_bands`` bands."""
    best = None
    for rows in range(1, 33):
        hit = similarity**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands <= max_bands:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band layout reaches this recall")
    return best


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``x[i : i + width]`` for every i."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def window_starts(tokens: np.ndarray, natural: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int, spread: int = SPREAD) -> np.ndarray:
    """Words where windows begin: ``natural`` starts; where there is none among ``spread`` neighbours the one with the least hashed shingle (winnowing); each text's first and last window.

    Whether a word is chosen depends on nearby words of its text only, so equal
    passages of ``window + spread - 1`` words have a window at the same words
    wherever they stand, and shorter ones if they begin at a natural start.
    Where one shingle repeats within reach, every ``spread``-th place is enough.
    """
    sizes = ends - begins
    n = len(tokens)
    if not n or not (sizes >= window).any():
        return np.zeros(0, np.int64)
    last = np.repeat(ends - window, sizes)[:n]
    m = mix64(tokens, 5)
    chosen = np.zeros(n, bool)
    if n >= spread:
        lows = slide_min(m, spread)
        so_far = np.concatenate([[0], np.cumsum(natural[:n])])
        open_ = (so_far[spread:] == so_far[: len(lows)]) & (np.arange(len(lows)) + spread - 1 <= last[: len(lows)])  # all of them starts of one text
        none = np.zeros(spread - 1, np.uint64)
        chosen = ~slide_min(~np.concatenate([none, np.where(open_, lows, np.uint64(0)), none]), spread) == m
    at = np.flatnonzero(chosen)
    if len(at):
        new = np.concatenate([[True], (m[at[1:]] != m[at[:-1]]) | (np.diff(at) > spread)])
        run = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        step = (at - run) // spread
        at = at[new | np.concatenate([[True], step[1:] != step[:-1]])]
    fits = sizes >= window
    at = np.unique(np.concatenate([at, np.flatnonzero(natural[:n]), begins[fits], (ends - window)[fits]]))
    return at[at <= last[at]]


def parities(tokens: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """Parity signatures of ``words`` words each of sets that follow one another (``jaccard_join.parity_signature``)."""
    cells = 64 * words
    cell = (mix64(tokens, 99) >> np.uint64(40)).astype(np.int64) % cells + np.repeat(np.arange(len(sizes)) * cells, sizes)
    odd = np.bincount(cell, minlength=len(sizes) * cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Units:
    """Paragraph units of several texts: windows of ``window`` words, and whole lines and paragraphs (up to a blank line) of that many words or more.

    Of unit i, ``text[i]`` is its text's number, ``first[i]`` and ``size[i]``
    say which words, ``keys[i, band]`` are the band keys and ``prints[i]``
    stands for its words.
    """

    def __init__(self, raws: list[bytes], k: int, window: int, percent: int, bands: int, rows: int):
        words = WordHashes(raws)
        self.k, self.window, self.bands = k, window, bands
        self.words = words.sizes
        ends = np.cumsum(self.words)
        begins = ends - self.words
        h, self.tokens = words.hashes, shingles(words.hashes, k)
        b = np.frombuffer(words.joined, np.uint8)
        breaks = np.searchsorted(words.starts, np.flatnonzero(b == 10))
        natural = np.zeros(len(h) + 1, bool)
        stop = np.isin(b[words.stops - 1], [33, 46, 63])  # . ! ?
        natural[1:-1] = stop[:-1] & ~stop[1:]
        natural[breaks] = True
        natural[begins] = True  # whatever text comes before
        at = window_starts(self.tokens, natural, begins, ends, window)
        self.wide, self.windows = window - k + 1, len(at)
        cuts = np.unique(np.concatenate([breaks, begins, [len(h)]]))
        line, size = cuts[:-1], np.diff(cuts)
        whole = size >= window
        gaps = np.diff(np.searchsorted(np.flatnonzero(b == 10), words.starts), prepend=0)
        blocks = np.unique(np.concatenate([np.flatnonzero(gaps > 1), begins, [len(h)]])) if len(h) else np.zeros(1, np.int64)
        block, size_of_blocks = blocks[:-1], np.diff(blocks)
        broken = np.searchsorted(cuts, blocks[1:]) - np.searchsorted(cuts, block, "right") > 0  # of several lines
        several = (size_of_blocks >= window) & broken
        lines, size_of_lines = np.concatenate([line[whole], block[several]]), np.concatenate([size[whole], size_of_blocks[several]])
        self.at = np.concatenate([at, lines])
        self.size = np.concatenate([np.full(len(at), window), size_of_lines])
        owner = np.searchsorted(ends, self.at, "right")
        self.text, self.first = owner, self.at - begins[owner]
        self.prints = np.zeros(len(self.at), np.uint64)
        own = self.prints[: len(at)]
        for j in [*range(0, self.wide - 1, k), self.wide - 1] if len(at) else []:
            own[:] = mix64(own ^ self.tokens[at + j], 7)
        self.prints[len(at) :] = mix64(np.concatenate([sequence_hashes(h, line, size)[whole], sequence_hashes(h, block, size_of_blocks)[several]]), 8)
        edges = np.stack([lines, lines + size_of_lines - k + 1], axis=1).ravel()
        self.keys = np.zeros((len(self.at), bands), np.uint64)
        self.firsts: list[np.ndarray] = []  # of each band, the hashes whose least its first row is
        for band in range(bands if len(self.at) else 0):
            for row in range(rows):
                m = mix64(self.tokens, 20 + band * rows + row)
                if not row:
                    self.firsts.append(m)
                least = np.concatenate([slide_min(m, self.wide)[at], np.minimum.reduceat(np.append(m, _TOP), edges)[::2] if len(lines) else m[:0]])
                self.keys[:, band] = mix64(self.keys[:, band] ^ least, band + 1)
            self.keys[len(at) :, band] = mix64(self.keys[len(at) :, band], 70)  # lines and paragraphs meet each other
        need = -(-2 * percent * self.wide // (100 + percent))
        self.lost = self.wide - need  # shingles that two windows of the similarity may each have apart

    def new_keys(self) -> np.ndarray:
        """Which keys differ from those of the window before, so that a key leaves a text about once."""
        out = np.ones(self.keys.shape, bool)
        w = self.windows
        if w > 1:
            out[1:w] = (self.keys[1:w] != self.keys[: w - 1]) | (self.text[1:w] != self.text[: w - 1])[:, None]
        return out

    def meetings(self, at: np.ndarray, hit: np.ndarray):
        """Where the units ``at`` meet others, as (unit, token) pairs; ``hit[unit, band]`` says which band keys are shared.

        Two windows of the similarity, in which no shingle repeats, have at
        most ``lost`` shingles each that the other lacks, and as a change
        inside takes more, all of these are at the edges.  So the least
        shingle stands at most ``lost`` places apart in the two, and the
        shingles around it agree; a band's key is met together with its place,
        in stretches that overlap by ``lost``, and with those shingles.  Lines
        and windows with repeats are met by the band's key alone.
        """
        w = np.flatnonzero(at < self.windows)
        inside = self.at[at[w]][:, None] + np.arange(self.wide)
        grid = np.sort(self.tokens[inside], axis=1)
        plain = ~(grid[:, 1:] == grid[:, :-1]).any(axis=1) & (0 < 4 * self.lost < self.wide) & (self.lost <= self.k - 2)
        inside, w = inside[plain], w[plain]
        alone = np.ones(len(at), bool)
        alone[w] = False
        i, band = np.nonzero(hit & alone[:, None])
        unit, token = [at[i]], [self.keys[at[i], band]]
        step = self.lost + 1
        around = shingles(self.tokens, self.wide - 4 * self.lost) if len(w) else None
        for band in range(self.bands if len(w) else 0):
            place = np.argmin(self.firsts[band][inside], axis=1)
            for back in (0, 1):
                stretch = place // step - back
                ok = hit[w, band] & (stretch >= 0) & (place <= stretch * step + 2 * self.lost)
                own, stretch = at[w[ok]], stretch[ok]
                of = around[self.at[own] + place[ok] + self.lost - stretch * step]
                unit.append(own)
                token.append(mix64(self.keys[own, band] ^ of, 41) ^ stretch.astype(np.uint64))
        return np.concatenate(unit), mix64(np.concatenate(token), 9)

    def shingle_sets(self, at: np.ndarray):
        """Sizes, tokens one after another, and parity signatures of the shingle sets of the units ``at`` (ascending): of all, and wider ones of those of more than ``WIDE_FROM``."""
        w = int(np.searchsorted(at, self.windows))
        grid = np.sort(self.tokens[self.at[at[:w]][:, None] + np.arange(self.wide)], axis=1)
        new = np.ones(grid.shape, bool)
        new[:, 1:] = grid[:, 1:] != grid[:, :-1]
        each = [np.unique(self.tokens[first : first + size - self.k + 1]) for first, size in zip(self.at[at[w:]].tolist(), self.size[at[w:]].tolist(), strict=True)]
        sizes = np.concatenate([new.sum(axis=1), np.array([len(x) for x in each], np.int64)])
        tokens = np.concatenate([grid[new], *each])
        large = sizes > WIDE_FROM
        return sizes, tokens, parities(tokens, sizes, SIGN_WORDS), parities(tokens[np.repeat(large, sizes)], sizes[large], WIDE_WORDS)


def _text_key(text: Column) -> Column:
    """Stands for a text, in every pass over it."""
    return F.xxhash64(text)


def _long(x):
    import pyarrow as pa

    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _lists(values, sizes, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


_FOUND = "row bigint, n bigint, first array<int>, size array<int>, print array<bigint>, node array<bigint>, token array<bigint>"
_SETS = "node bigint, n bigint, tokens array<bigint>, sign array<bigint>, wide array<bigint>"


def _clustered(docs: DataFrame, shingle_words: int, percent: int, window: int, recall: float, max_bands: int, id_col: str, text_col: str, scratch: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Places of clusters that reach two texts: row, doc_id, first, size, cluster, keep_doc_id, keep_row; and of equal texts all but the one that stays.

    A text is known by a hash of it (``row``); equal texts are worked on once,
    under the least id.  Units (lines, paragraphs and windows) whose band keys meet in
    another text are looked at further: those of equal words are one class,
    others are linked by the exact Jaccard similarity of their shingles, and
    links are closed to components.  In a component that reaches two texts,
    the places of the text with the least (id, hash) stay.
    """
    spark = docs.sparkSession
    bands, rows = tune_bands(percent / 100, recall, max_bands)
    text = F.col(text_col).cast("string")
    texts = docs.select(_text_key(text).alias("row"), text.alias("text"))

    def each(batches, wanted=None):
        """(rows, units) of some texts at a time, those met before or not ``wanted`` left out."""
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ok = np.ones(len(ids), bool) if wanted is None else wanted.among(ids.view(np.uint64))
            fresh = []
            for i in np.flatnonzero(ok).tolist():
                if ids[i] not in seen:
                    fresh.append(i)
                    if len(seen) < MEMO:
                        seen.add(ids[i])
            fresh = np.array(fresh, np.int64)
            part, ids = batch.take(fresh), ids[fresh]
            for at, raws in text_blocks(part.column(1)):
                yield ids[at : at + len(raws)], Units(raws, shingle_words, window, percent, bands, rows)

    def keys_of(batches):
        import pyarrow as pa

        for ids, u in each(batches):
            new = u.new_keys()
            yield pa.record_batch([_long(u.keys[new]), _long(np.broadcast_to(ids[u.text][:, None], new.shape)[new])], names=["key", "row"])

    sides = texts.mapInArrow(keys_of, "key bigint, row bigint").groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    shared = settle(sides.where("a <> b").select("key"), "keys")
    bloom = spark.sparkContext.broadcast(bloom_of(shared, "key"))
    discard(shared)

    def found_in(batches):
        import pyarrow as pa

        seen = set()
        names = [x.split(" ")[0] for x in _FOUND.split(", ")]
        for ids, u in each(batches):
            hit = bloom.value.among(u.keys.ravel()).reshape(u.keys.shape)
            at = np.flatnonzero(hit.any(axis=1))
            order = np.argsort(u.text[at], kind="stable")
            per = np.bincount(u.text[at], minlength=len(ids))
            lists = [_lists(x[at][order], per, kind) for x, kind in ((u.first.astype(np.int32), pa.int32()), (u.size.astype(np.int32), pa.int32()), (u.prints.view(np.int64), pa.int64()))]
            prints = u.prints[at]
            _, one = np.unique(prints, return_index=True)
            one = np.array([i for i in one.tolist() if prints[i] not in seen], np.int64)
            if len(seen) < MEMO:
                seen.update(prints[one])
            unit, token = u.meetings(at[one], hit[at[one]])
            order = np.argsort(u.text[unit], kind="stable")
            per = np.bincount(u.text[unit], minlength=len(ids))
            met = [_lists(x[order].view(np.int64), per, pa.int64()) for x in (u.prints[unit], token)]
            yield pa.record_batch([_long(ids), _long(u.words), *lists, *met], names=names)

    both = settle(texts.mapInArrow(found_in, _FOUND), "found")
    bloom.destroy()  # here and below: else the driver holds all the tables of this call at once
    found = settle(both.drop("node", "token"), "found")
    entries = both.select("row", F.explode(F.arrays_zip("token", "node")).alias("e")).select("e.token", "e.node", "row")
    meets = settle(entries.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("token"), "meets")
    met = spark.sparkContext.broadcast(bloom_of(meets, "token"))
    entries = let_through(entries, "token", met)  # a token too much meets nothing later
    nodes = settle(entries.groupBy("node").agg(F.min("row").alias("holder"), F.collect_set("token").alias("p1")), "nodes")
    met.destroy()
    discard(both, meets)
    holders, pairs = spark.sparkContext.broadcast(bloom_of(nodes, "holder")), spark.sparkContext.broadcast(bloom_of(nodes, "node", with_="holder"))

    def sets_of(batches):
        """The shingle sets that are needed, each from the text that is its holder."""
        import pyarrow as pa

        for ids, u in each(batches, holders.value):
            at = np.flatnonzero(pairs.value.among(paired(u.prints, ids[u.text])))
            for lo in range(0, len(at), 4096):
                own = at[lo : lo + 4096]
                sizes, tokens, signs, wide = u.shingle_sets(own)
                lists = [_lists(x, per, pa.int64()) for x, per in ((tokens.view(np.int64), sizes), (signs, np.full(len(own), SIGN_WORDS)), (wide, WIDE_WORDS * (sizes > WIDE_FROM)))]
                yield pa.record_batch([_long(u.prints[own]), _long(sizes), *lists], names=["node", "n", "tokens", "sign", "wide"])

    whole = settle(texts.mapInArrow(sets_of, _SETS), "whole")  # with its tokens a set is shuffled only when a pair needs it
    holders.destroy()
    pairs.destroy()
    sets = settle(whole.drop("tokens").dropDuplicates(["node"]).join(nodes.drop("holder"), "node"), "sets")
    discard(nodes)
    labels = link_entries(sets.select("node", "n", F.explode("p1").alias("token")), sets, percent, whole=whole)

    stamps = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text).alias("row"), F.xxhash64(F.lit(1), text).alias("check"))
    stamps = settle(stamps.where(text.rlike(r"[^\x20\x09-\x0D]")).groupBy("doc_id", "row", "check").agg(F.count("*").alias("times")), "stamps")
    of_text = settle(stamps.groupBy("row", "check").agg(F.min("doc_id").alias("least"), F.sum("times").alias("times")), "texts")
    whole = found.dropDuplicates(["row"]).join(of_text.groupBy("row").agg(F.min("least").alias("doc_id")), "row")
    places = whole.where(F.size("first") > 0).select("row", "doc_id", F.explode(F.arrays_zip("first", "size", "print")).alias("u")).select("row", "doc_id", "u.first", "u.size", "u.print")
    places = settle(places, "places")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("place")
    prints = places.groupBy("print").agg(F.min(place).alias("keep"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    prints = prints.join(labels, F.col("print") == F.col("node"), "left").select("print", F.coalesce("component", "print").alias("cluster"), "keep", "lo", "hi")
    prints = settle(prints, "prints")
    clusters = prints.groupBy("cluster").agg(F.min("keep").alias("keep"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("cluster", "keep")
    kept = settle(prints.drop("keep").join(clusters, "cluster").select("print", "cluster", "keep"), "kept")
    near = fit_for_broadcast(kept, MOST_ROWS // 4)
    wanted = spark.sparkContext.broadcast(bloom_of(kept, "print")) if near is kept else None
    held = (let_through(places, "print", wanted) if wanted else places).join(near, "print")
    held = settle(held.select("row", "doc_id", "first", "size", "cluster", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.row").alias("keep_row")), "clusters")
    if wanted:
        wanted.destroy()

    twice = settle(of_text.where("times > 1").join(found.select("row", "n").dropDuplicates(["row"]), "row"), "twice")
    copies = stamps.join(fit_for_broadcast(twice.drop("times"), MOST_ROWS // 4), ["row", "check"])
    discard(labels, places, prints, kept, found, of_text)
    if scratch is not None:
        scratch += [held, stamps, twice]
    return held, copies


def _spans(windows: DataFrame, group: list[str]) -> DataFrame:
    """Overlapping or touching places of a text that agree in ``group`` (which sets the keeper) make one span."""
    by = Window.partitionBy("row", *group).orderBy("first")
    end = F.col("first") + F.col("size")
    windows = windows.withColumn("_new", F.coalesce(F.col("first") > F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    windows = windows.withColumn("_span", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return windows.groupBy("row", *group, "_span").agg(
        F.first("doc_id").alias("_id"), F.min("first").cast("bigint").alias("first_word"), F.max(end).cast("bigint").alias("end_word"),
        F.min("cluster").alias("_cluster"), F.first("keep_doc_id").alias("keep_doc_id"), F.first(F.col("row") == F.col("keep_row")).alias("kept"),
    ).select(F.col("_id").alias("doc_id"), "first_word", "end_word", F.col("_cluster").alias("cluster"), "keep_doc_id", "kept", F.lit(1).cast("bigint").alias("n_rows"), F.lit(False).alias("but_one"), F.col("row").alias("text_key"))


def _copies(copies: DataFrame, members: bool) -> DataFrame:
    """Whole equal texts: ``n_rows`` rows of an id go, all of them or (``but_one``) all but one, which stays."""
    stays = F.col("doc_id").eqNullSafe(F.col("least"))
    row = lambda n, kept: F.struct(n.cast("bigint").alias("n_rows"), F.lit(kept).alias("kept"))
    parts = F.array(row(F.col("times") - stays.cast("long"), False), *([row(stays.cast("long"), True)] if members else []))
    out = copies.select("doc_id", "n", "least", "row", stays.alias("but_one"), F.explode(parts).alias("part")).where("part.n_rows > 0")
    return out.select("doc_id", F.lit(0).cast("bigint").alias("first_word"), F.col("n").alias("end_word"), F.col("row").alias("cluster"), F.col("least").alias("keep_doc_id"), "part.kept", "part.n_rows", "but_one", F.col("row").alias("text_key"))


def _named(spans: DataFrame, id_col: str) -> DataFrame:
    return spans.select(F.col("doc_id").alias(id_col), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "cluster", "keep_doc_id", "kept", "n_rows", "but_one", "text_key")


def repeat_members(
    docs: DataFrame,
    *,
    shingle_words: int = 5,
    percent: int = 80,
    window: int = 25,
    recall: float = 0.99,
    max_bands: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Who belongs to which cluster: doc_id, first_word, end_word, n_words, cluster, keep_doc_id, kept, n_rows, text_key.

    One row per place of a text and cluster, with the id that keeps this
    cluster; ``kept`` marks the places of the keeper itself, which stay.  So
    places of different clusters may overlap, and each cluster is whole.
    Equal texts are a cluster of their own, with ``n_rows`` rows of the table
    in one row here; what they share with other texts is listed under their
    keeper.  Otherwise as ``find_repeats``.
    """
    held, copies = _clustered(docs, shingle_words, percent, window, recall, max_bands, id_col, text_col)
    return _named(_spans(held, ["cluster"]).union(_copies(copies, True)), id_col).drop("but_one")


def find_repeats(
    docs: DataFrame,
    *,
    shingle_words: int = 5,
    percent: int = 80,
    window: int = 25,
    recall: float = 0.99,
    max_bands: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    scratch: list[DataFrame] | None = None,
) -> DataFrame:
    """Spans of words to remove: doc_id, first_word, end_word, n_words, cluster, keep_doc_id, n_rows, but_one, text_key.

    Units are the lines and the paragraphs (up to a blank line) of at least
    ``window`` words, however they are wrapped, and windows of ``window`` words from each line and sentence on and from places chosen by
    content in long sentences, so that any passage of ``window + SPREAD - 1``
    words has one wherever it stands.  MinHash
    bands are tuned so that units of ``percent`` similarity of their
    ``shingle_words``-word shingles meet with chance ``recall``.

    A span is made of overlapping units with one keeper, and ``cluster`` is
    the least of their clusters (``repeat_members`` has them all); spans with
    different keepers may overlap, and their text is still whole in the rows
    that keep it.  ``text_key`` is the hash of the row's text, so that rows of
    one id are told apart.

    Equal texts of any length with a word are one class; the one with the
    least id stays and the others are one span each, with ``n_rows`` equal
    rows in one; ``but_one`` says that one row more of this id and text stays.
    Other texts of fewer than ``window`` words, null and empty ones have no
    spans.  Null ids come after all others; ties go to the least id, then the
    least hash of the text; other columns aren't read; texts of any length are
    worked on whole; an empty table gives an empty result.  Tables that the
    result still reads are added to ``scratch``, for a caller that settles it
    and discards them.
    """
    held, copies = _clustered(docs, shingle_words, percent, window, recall, max_bands, id_col, text_col, scratch)
    spans = _spans(held.where(F.col("row") != F.col("keep_row")), ["keep_row"])
    return _named(spans.union(_copies(copies, False)), id_col).drop("kept")


def cut_words(text: str | None, spans) -> str | None:
    """The text without the words of the spans (first, end), each with the white space behind it."""
    if text is None or spans is None or not len(spans):
        return text
    raw = text.encode()
    at = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, last = [], 0
    for span in sorted((s["first_word"], s["end_word"]) for s in spans):
        out.append(raw[last : max(last, at[min(span[0], len(at) - 1)])])
        last = max(last, at[min(span[1], len(at) - 1)])
    return b"".join([*out, raw[last:]]).decode()


def _cut_all(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return texts.combine(spans, cut_words)


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, max_broadcast_spans: int = 200_000, scratch: list[DataFrame] | None = None) -> DataFrame:
    """``docs`` with the spans of ``find_repeats`` cut out of their texts; with ``drop_emptied``, without the rows that lose all their words.

    Rows are met by id and text, so rows that share an id keep their own
    words; of equal rows with one id all but one are emptied.  Null and empty
    texts, untouched texts and all other columns, whatever their names, pass
    unchanged.  A span table of more than ``max_broadcast_spans`` spans is
    shuffled to the rows.  An empty table of either kind is fine.  Tables that
    the result still reads are added to ``scratch``.
    """
    cut = F.struct("first_word", "end_word")
    own = spans.groupBy(F.col(id_col).cast("long").alias("id"), F.col("text_key").alias("key")).agg(
        F.collect_list(F.when(~F.col("but_one"), cut)).alias("cuts"), F.max(F.when(F.col("but_one"), F.col("end_word"))).alias("whole")
    )
    own = settle(own.withColumn("n", F.size("cuts")), "spans")
    left_over = [own]
    if (own.agg(F.sum("n")).first()[0] or 0) <= max_broadcast_spans:
        own = fit_for_broadcast(own, max_broadcast_spans)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"))
    same = F.col("d").getField(id_col).cast("long").eqNullSafe(F.col("id")) & (_text_key(F.col("d").getField(text_col).cast("string")) == F.col("key"))
    met = rows.join(own, same, "left").select("d", "id", "key", "cuts", "whole")
    if not own.where("whole is not null").isEmpty():
        equal = settle(met.where("whole is not null").withColumn("at", F.monotonically_increasing_id()), "equal")
        stays = settle(equal.groupBy("id", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("stays")), "stays")
        all_of = F.array(F.struct(F.lit(0).cast("bigint").alias("first_word"), F.col("whole").alias("end_word")))
        left_over += [equal, stays]
        equal = equal.join(fit_for_broadcast(stays, max_broadcast_spans), "at", "left").withColumn("cuts", F.when(F.col("stays"), F.col("cuts")).otherwise(all_of))
        met = met.where("whole is null").union(equal.select("d", "id", "key", "cuts", "whole"))
    if scratch is not None:
        scratch += left_over
    hit, before = F.size("cuts") > 0, F.col("d").getField(text_col)
    cutter = F.pandas_udf(_cut_all, "string").asNondeterministic()  # so that it runs once a row
    met = met.withColumn("left", F.when(hit, cutter(F.when(hit, before), F.col("cuts"))).otherwise(before))
    if drop_emptied:
        met = met.where(F.col("key").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return met.select(*[F.col("left").alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns])
