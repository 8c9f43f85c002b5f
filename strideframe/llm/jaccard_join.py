"""Jaccard self-join on word shingles with prefix filters under several token orders."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import WordHashes, discard, fit_for_broadcast, mix64, settle, shingles, text_blocks
from strideframe.llm.components import merged_labels

SKETCH = 1 << 22  # cells of the frequency classes that lead the token orders
SKETCH_LEAST = 8  # times a token is seen twice or more within stretches before it counts as frequent
STRETCH = 2_000_000  # shingles whose repeats are looked for together
SMALL = 6  # sets under one token that are compared outright
MIDDLE = 64  # sets under one token whose last pairs a join makes; larger ones are compared in blocks
SIGN_WORDS = 32  # 64-bit words of a parity signature
BLOCK = 1024  # queries, and members, that meet in one group
MOST_ENDS = 1_000_000  # ids of sets, broadcast at most
MOST_HUBS = 200_000  # broadcast at most
FEW_PAIRS = 1_000_000  # so many left of all tokens together are made without further hubs


def prefix_size(n: int, percent: int) -> int:
    """Two sets of ``percent`` similarity share a token among each one's so many first, under any one order."""
    return n - -(-percent * n // 100) + 1


def ranks(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """A global order: frequency class first, then a hash that ``order`` seeds."""
    level = classes[tokens & np.uint64(len(classes) - 1)].astype(np.uint64)
    return (level << np.uint64(58)) | (mix64(tokens, order) >> np.uint64(6))


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int, more: int = 0) -> np.ndarray:
    p = prefix_size(len(tokens), percent) + more
    return tokens if p >= len(tokens) else tokens[np.argpartition(ranks(tokens, classes, order), p - 1)[:p]]


def longer(n: int, percent: int) -> int:
    """So many tokens more than the prefix are looked at."""
    return prefix_size(n, percent) // 2


@lru_cache(1 << 16)
def least_shared(n: int, percent: int) -> int:
    """A set of ``n`` tokens has at least so many in common with the longer prefix of any set of ``percent`` similarity, within its own.

    Common tokens outside of both longer prefixes are at most as many as the
    larger of the two rests, whatever the order.
    """
    m = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    rest = lambda x: np.maximum(x - prefix_size(x, percent) - longer(x, percent), 0)
    return int((-(-percent * (n + m) // (100 + percent)) - np.maximum(rest(n), rest(m))).min())


def parity_signature(tokens: np.ndarray, words: int = SIGN_WORDS) -> np.ndarray:
    """Bit i is the parity of the tokens in cell i: two of these differ in at most as many bits as the sets in tokens."""
    odd = np.bincount((mix64(tokens, 99) >> np.uint64(40)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bloom_places(keys: np.ndarray, probe: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a probe in a table of 2**width bits."""
    at = mix64(keys, 11 + probe) >> np.uint64(64 - width)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


class Bloom:
    """A bit table with four probes; it only ever lets too much through."""

    def __init__(self, width: int):
        self.width, self.words = width, np.zeros(1 << width - 6, np.uint64)

    def among(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for probe in range(4):
            word, bit = bloom_places(keys, probe, self.width)
            found &= self.words[word] & bit != 0
        return found


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for two."""
    return mix64(a.view(np.uint64), 51) ^ b.view(np.uint64)


def bloom_of(tokens: DataFrame, column: str, with_: str | None = None, bits_each: int = 12, least_bits: int = 20, most_bits: int = 28) -> Bloom:
    """Of the column's keys, or of pairs ``with_`` another column; marked by tasks, and the marks meet as words of the table.

    Its 2**most_bits bits at most (32 MB, and twice that on the way to the
    driver) bound what is broadcast; with more tokens than they have room for
    it lets more through, which costs work and loses nothing.
    """
    width = min(max(max(1, bits_each * tokens.count() - 1).bit_length(), least_bits), most_bits)

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            keys = paired(*keys) if with_ else keys[0]
            word, bit = (np.concatenate(x) for x in zip(*[bloom_places(keys, p, width) for p in range(4)], strict=True))
            yield pa.record_batch([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bits"])

    marks = tokens.select(column, *([with_] if with_ else [])).mapInArrow(mark, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = Bloom(width)
    for batch in marks.toArrow().to_batches():
        out.words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def let_through(rows: DataFrame, column: str, bloom) -> DataFrame:
    """The rows whose key in ``column`` is in a broadcast table: what is to be met is filtered where it lies, before it is shuffled."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(bloom.value.among(batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def _sets(batch, k: int):
    """(position, digest, sorted distinct shingles) of each text of a batch."""
    import xxhash

    for first, raws in text_blocks(batch.column(batch.num_columns - 1)):
        words = WordHashes(raws)
        tokens, ends = shingles(words.hashes, k), np.cumsum(words.sizes)
        for i, (n, end) in enumerate(zip(words.sizes.tolist(), ends.tolist(), strict=True)):
            own = np.sort(tokens[end - n : end - k + 1]) if n >= k else shingles(words.hashes[end - n : end], k)
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            digest = xxhash.xxh3_128_intdigest(own.tobytes())
            signed = np.array([digest >> 64, digest & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64)
            yield first + i, (int(signed[0]), int(signed[1])), own


def _signatures(texts: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document its set's size and digest; the tokens seen at least twice within a stretch of documents; the table of both."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "text_key", "n", "d1", "d2", "tokens", "times"]

        def frequent():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            tokens, times = tokens[times > 1].view(np.int64), times[times > 1]
            for at in range(0, len(tokens), 50_000):
                row = [[None], [None], [-1], [None], [None], [tokens[at : at + 50_000]], [times[at : at + 50_000]]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            n, d1, d2 = [], [], []
            for _, digest, tokens in _sets(batch, k):
                n.append(len(tokens))
                d1.append(digest[0])
                d2.append(digest[1])
                held.append(tokens)
                size += len(tokens)
                if size > STRETCH:
                    yield from frequent()
                    held, size = [], 0
            none = pa.nulls(len(n), kinds[5])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), none, none], names=names)
        if held:
            yield from frequent()

    kind = "doc_id bigint, text_key bigint, n bigint, d1 bigint, d2 bigint, tokens array<bigint>, times array<bigint>"
    both = settle(texts.mapInArrow(run, kind), "signatures")
    seen = both.where("n < 0").select(F.explode(F.arrays_zip("tokens", "times")).alias("x")).groupBy("x.tokens").agg(F.sum("x.times").alias("times"))
    return both.where("n >= 0").drop("tokens", "times"), seen, both


def _frequency_classes(seen: DataFrame) -> np.ndarray:
    """Cells of token hashes with the binary logarithm of the times their most frequent token was seen."""
    cells = seen.where(F.col("times") >= SKETCH_LEAST).groupBy((F.col("tokens").bitwiseAND(F.lit(SKETCH - 1))).alias("cell")).agg(F.max("times").alias("times"))
    classes = np.zeros(SKETCH, np.uint8)
    for batch in cells.select("cell", F.least(F.floor(F.log2("times")), F.lit(31)).cast("int").alias("level")).toArrow().to_batches():
        classes[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return classes


def _shared_tokens(texts: DataFrame, k: int, percent: int, classes) -> DataFrame:
    """Tokens that stand in the longer prefixes (first order) of two different sets."""

    def run(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            out, own = [], []
            for _, digest, tokens in _sets(batch, k):
                if not len(tokens) or digest in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(digest)
                out.append(prefix(tokens, classes.value, 1, percent, longer(len(tokens), percent)))
                own.append(np.full(len(out[-1]), digest[0], np.int64))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(own))], names=["token", "d1"])

    sides = texts.mapInArrow(run, "token bigint, d1 bigint").groupBy("token").agg(F.min("d1").alias("a"), F.max("d1").alias("b"))
    return settle(sides.where("a <> b").select("token"), "shared")


def _candidate_sets(texts: DataFrame, k: int, percent: int, classes, bloom) -> DataFrame:
    """Sets with enough shared tokens in their longer prefix: tokens, shared prefix tokens, the prefixes of two more orders, signature."""

    def run(batches):
        import pyarrow as pa

        seen = set()
        many = pa.list_(pa.int64())
        for batch in batches:
            out = []
            for _, digest, tokens in _sets(batch, k):
                if not len(tokens) or digest in seen:
                    continue
                more = longer(len(tokens), percent)
                if bloom.value.among(prefix(tokens, classes.value, 1, percent, more)).sum() < least_shared(len(tokens), percent):
                    continue
                first = prefix(tokens, classes.value, 1, percent)
                first = first[bloom.value.among(first)]
                if len(first):
                    if len(seen) < 200_000:
                        seen.add(digest)
                    other = [prefix(tokens, classes.value, order, percent).view(np.int64) for order in (2, 3)]
                    out.append((*digest, len(tokens), tokens.view(np.int64), first.view(np.int64), *other, parity_signature(tokens)))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 3 + [many] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["d1", "d2", "n", "tokens", "p1", "p2", "p3", "sign"])

    kind = "d1 bigint, d2 bigint, n bigint, tokens array<bigint>, p1 array<bigint>, p2 array<bigint>, p3 array<bigint>, sign array<bigint>"
    return texts.mapInArrow(run, kind)


def _least_overlap(percent: int, x, y):
    return F.ceil((x + y) * percent / F.lit(100.0 + percent) - 1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, whole: DataFrame | None = None) -> DataFrame:
    """Links among ``pairs``, settled: signatures bound the overlap, the other orders' prefixes must meet, then the sets are intersected.

    Longer signatures (``wide``, empty for small sets) are compared too, where ``sets`` has them.  ``whole``: see ``link_entries``.
    """
    signs = [c for c in ("sign", "wide") if c in sets.columns]
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"{c}_a") for c in signs])
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"{c}_b") for c in signs])
    apart = lambda c: F.aggregate(F.zip_with(f"{c}_a", f"{c}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = F.col("na") + F.col("nb") - 2 * _least_overlap(percent, F.col("na"), F.col("nb"))  # tokens that only one of the two has
    near = pairs.join(a, "a").join(b, "b").where(apart("sign") <= most)
    if "wide" in signs:
        near = near.where((F.size("wide_a") != F.size("wide_b")) | (apart("wide") <= most))
    near = settle(near.select("a", "b"), "near")
    if near.isEmpty():
        return near
    ends = settle(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    sets = (sets if whole is None else whole.select("node", "tokens")).join(fit_for_broadcast(ends, MOST_ENDS), "node", "left_semi")  # only these sets are shuffled whole
    sets = sets if whole is None else sets.dropDuplicates(["node"])
    others = [c for c in ("p2", "p3") if c in sets.columns]
    a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"), *[F.col(c).alias(f"{c}_a") for c in others])
    b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"), *[F.col(c).alias(f"{c}_b") for c in others])
    both = near.join(a, "a").join(b, "b")
    for c in others:
        both = both.where(F.arrays_overlap(f"{c}_a", f"{c}_b"))
    both = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("i"), (F.size("ta") + F.size("tb")).alias("s"))
    links = settle(both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b"), "links")
    discard(near, ends)
    return links


def _comparable(percent: int, x: str, y: str):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _cross_pairs(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of different labels under a token, each once, that signatures leave possible.

    Under a token, the members outside its largest label are queries against
    all members.  Both are dealt to blocks, and a group is one block of
    queries with one of members.  A pair is made under the least token that
    both prefixes share.
    """
    by_label = entries.groupBy("token", "label").agg(F.count("*").alias("c"))
    main = by_label.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"), F.count("*").alias("labels"))
    wide = [c for c in ("wide",) if c in sets.columns]
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.where("labels > 1").select("token", "main", blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("most")).alias("query_blocks"))
    rows = entries.join(main, "token").join(sets.select("node", "p1", "sign", *wide), "node")
    rows = settle(rows, "cross")
    dealt = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["node", "label", "n", "p1", "sign", "main", *wide]
    held = rows.select("token", dealt(1, "blocks").alias("block"), every("query_blocks").alias("query_block"), F.lit(False).alias("query"), *own)
    query = rows.where("label <> main").select("token", every("blocks").alias("block"), dealt(2, "query_blocks").alias("query_block"), F.lit(True).alias("query"), *own)

    def compare(key, pdf):
        import pandas as pd

        token = key[0]
        q, m = pdf[pdf["query"]], pdf[~pdf["query"]]
        out = []
        if len(q) and len(m):
            nodes, labels, sizes = m["node"].to_numpy(), m["label"].to_numpy(), m["n"].to_numpy()
            signs = np.stack(m["sign"].to_numpy()).view(np.uint64)
            firsts = [set(p.tolist()) for p in m["p1"]]
            main = m["main"].iloc[0]
            large, of_queries = (m["wide"], q["wide"]) if wide else ([()] * len(m), [()] * len(q))
            has = np.array([len(x) > 0 for x in large])
            larger = np.zeros((len(m), max(map(len, large))), np.uint64)
            if has.any():
                larger[has] = np.stack([x for x in large if len(x)]).view(np.uint64)
            for node, label, n, p1, sign, more in zip(q["node"], q["label"], q["n"], q["p1"], q["sign"], of_queries, strict=True):
                ok = (labels != label) & ((labels == main) | (nodes > node)) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                at = np.flatnonzero(ok)
                apart = np.bitwise_count(signs[at] ^ np.asarray(sign).view(np.uint64)).sum(axis=1)
                most = sizes[at] + n - 2 * np.ceil((sizes[at] + n) * percent / (100.0 + percent) - 1e-9)
                at, most = at[apart <= most], most[apart <= most]
                if len(more) and len(at):
                    apart = np.bitwise_count(larger[at] ^ np.asarray(more).view(np.uint64)).sum(axis=1)
                    at = at[~has[at] | (apart <= most)]
                mine = set(p1.tolist())
                out += [(node, nodes[i]) for i in at if min(mine & firsts[i]) == token]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return held.union(query).groupBy("token", "query_block", "block").applyInPandas(compare, "a bigint, b bigint")


def link_entries(entries: DataFrame, sets: DataFrame, percent: int, hub_rounds: int = 3, whole: DataFrame | None = None) -> DataFrame:
    """(node, component) of the links among sets that meet under a token; least nodes are left out.

    ``entries`` (node, n, token; each once) says where sets meet.  ``sets``
    (node, tokens, p1: the tokens it has entries for, sign, and if given p2
    and p3: which must meet too) is a settled table.  ``whole`` (node, tokens)
    is another one with the tokens, where ``sets`` has none; a node may come
    several times.  Both are discarded; after the first round only the sets
    that may still meet others are kept.
    """
    entries = entries.join(entries.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "token")
    entries = settle(entries, "entries")
    few = entries.where(F.col("size") <= SMALL)
    a, b = few.select("token", F.col("node").alias("a"), F.col("n").alias("x")), few.select("token", F.col("node").alias("b"), F.col("n").alias("y"))
    pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & _comparable(percent, "x", "y")).select("a", "b")
    many = entries.where(F.col("size") > SMALL).select("token", "node", "n", F.col("node").alias("label"))
    labels, spent = None, [entries]
    turn = 0
    while turn <= hub_rounds:
        if turn < hub_rounds:
            hub = lambda seed: F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "n", "label"))
            hubs = many.groupBy("token").agg(F.array(hub(2 * turn), hub(2 * turn + 1)).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi"))
            hubs = settle(hubs.where("lo <> hi").select("token", F.explode("h").alias("h")), "hubs")
            spent.append(hubs)
            found = many.join(fit_for_broadcast(hubs, MOST_HUBS), "token").select(F.col("h.node").alias("a"), F.col("node").alias("b"), F.col("h.n").alias("x"), F.col("n").alias("y"), F.col("h.label").alias("la"), F.col("label").alias("lb"))
            found = found.where((F.col("la") != F.col("lb")) & _comparable(percent, "x", "y")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.union(found) if turn == 0 else found
        else:
            sized = many.join(many.groupBy("token").agg(F.count("*").alias("size")), "token")
            large = sized.where(F.col("size") > MIDDLE).drop("size")
            middle = sized.where(F.col("size") <= MIDDLE)
            a = middle.select("token", F.col("node").alias("a"), F.col("n").alias("x"), F.col("label").alias("la"))
            b = middle.select("token", F.col("node").alias("b"), F.col("n").alias("y"), F.col("label").alias("lb"))
            pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _comparable(percent, "x", "y")).select("a", "b")
            pairs = pairs.union(_cross_pairs(large, sets, percent))
        pairs = settle(pairs.distinct(), "pairs")
        links = pairs if pairs.isEmpty() else _verified(pairs, sets, percent, whole)
        new = labels is None or not (links is pairs or links.isEmpty())
        if new:
            before, labels = labels, merged_labels(labels, links)
            discard(*([before] if before is not None else []))
        discard(pairs, *([links] if links is not pairs else []))
        if turn < hub_rounds and new:
            many = many.drop("label").join(labels.select("node", F.col("component").alias("label")), "node", "left")
            many = many.select("token", "node", "n", F.coalesce("label", "node").alias("label"))
            left = many.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
            many = settle(many.join(left, "token"), "entries")
            discard(*spent)
            spent = [many]
            squares = many.groupBy("token").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
            if squares is None:
                break
            if turn == 0:
                rest = settle(many.select("node").distinct(), "rest")
                held = fit_for_broadcast(rest, MOST_ENDS)
                large = None if whole is None else settle(whole.select("node", "tokens").join(held, "node", "left_semi"), "whole")
                less = settle(sets.join(held, "node", "left_semi"), "sets")
                discard(rest, sets, *([] if whole is None else [whole]))
                sets, whole = less, large
            if squares <= FEW_PAIRS:
                turn = hub_rounds - 1
        turn += 1
    discard(*spent, sets, *([] if whole is None else [whole]))
    return labels


def jaccard_components(
    docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, hub_rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", with_class: bool = False, scratch: list[DataFrame] | None = None
) -> DataFrame:
    """(id, n_shingles, component_id) of every document; exact.

    ``with_class`` adds ``text_key`` (a hash of the text, which tells rows of
    one id apart) and ``class`` (of its component, null without words): ids
    that several texts share may make components of one ``component_id``.
    Tables that the result still reads are added to ``scratch``, for a caller
    that settles it and discards them.

    Documents link when ``100 * intersection >= percent * union`` of their
    distinct shingles (A-Z lower-cased; fewer words than ``shingle_words``
    make one shingle); ``component_id`` is the least id that links reach.

    Equal sets are one class.  Only sets that share enough tokens of a
    somewhat longer prefix with other sets, whichever, are looked at further.
    A token that stands in the prefixes of two of them under the first order
    makes them candidates; the orders put tokens that repeat a lot last and
    break ties by different hashes.  Few
    sets under a token are compared outright.  Many are first compared with
    one hub a round, and what links with it shares its label; after
    ``hub_rounds`` rounds, or when few are left, pairs of still different labels are compared, in
    blocks where they are many, so no group's pairs are all made and no link between components
    is lost.  Every pair passes the signature bound and the prefixes of the
    second and third order before its sets are intersected.

    Null and empty texts, and those of white space, have no shingles and are
    components of their own; null ids don't name a component (a component of
    null ids alone has a null one); repeated rows are one class; other columns
    aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    documents, seen, both = _signatures(texts, shingle_words)
    texts = texts.select("text")
    classes = spark.sparkContext.broadcast(_frequency_classes(seen))
    documents = settle(documents, "documents")
    discard(both)
    groups = documents.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
    groups = settle(groups.withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = _shared_tokens(texts, shingle_words, percent, classes)
    bloom = spark.sparkContext.broadcast(bloom_of(shared, "token"))
    discard(shared)
    sets = _candidate_sets(texts, shingle_words, percent, classes, bloom).dropDuplicates(["d1", "d2"])
    sets = settle(sets.join(groups.drop("least"), ["d1", "d2"]).drop("d1", "d2"), "sets")
    classes.destroy()
    bloom.destroy()

    labels = link_entries(sets.select("node", "n", F.explode("p1").alias("token")), sets, percent, hub_rounds)
    if scratch is not None:
        scratch += [documents, groups, labels]
    named = groups.join(labels, "node", "left").select("d1", "d2", "least", F.coalesce("component", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("d1", "d2", "label", "component_id")
    own = ["doc_id", F.col("n").alias("n_shingles"), "component_id", *(["text_key", F.col("label").alias("class")] if with_class else [])]
    full = documents.where("n > 0").join(named, ["d1", "d2"]).select(*own)
    alone = documents.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("label", F.lit(None).cast("bigint")).select(*own)
    return full.union(alone).withColumnRenamed("doc_id", id_col)
