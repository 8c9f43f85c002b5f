"""Byte-level BPE over a corpus: merges are replayed on its distinct words, and texts are put together of them."""

from __future__ import annotations

import base64
import functools
import heapq
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import discard, settle
from strideframe.llm.text_units import Numbers, Units, chunks, lists, numbered, ragged, sums_by, unit_pattern

BLOCK = 1 << 20  # bytes of distinct units whose merges are replayed together
MOST_UNITS = 3 << 17  # from which on a task begins to number them anew
LONG_WORD = 1 << 10  # bytes from which on a word is merged by itself


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number by line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Applies all merges of a vocabulary to many words at once.

    The words lie one after another as linked tokens.  An index leads from
    merges to the places of their pairs, in classes of neighbouring ranks that
    are worked off in rank order: in each step every word takes its place of
    least rank (the leftmost of equal ones), only the two neighbours that a
    merge touches are looked at again, and what they make goes to the index; a
    place whose pair is gone is skipped.  A pair of a lower rank than the merge
    that made it comes next, so each word has the result of merging it alone.
    A word that is a token itself is that token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = [(x << 32 | y, r) for token, r in ranks.items() for k in range(1, len(token)) if (x := ranks.get(token[:k])) is not None and (y := ranks.get(token[k:])) is not None]
        pairs = np.array(sorted(found) or [(-1, -1)], np.int64)
        self.pair, self.pair_rank = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.pairs = dict(found)
        self.edges = np.unique(np.concatenate([[0], 256 + np.geomspace(8, max(16, len(ranks)), 96).astype(np.int64)]))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the merges of token pairs; -1 without one."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        return np.where(self.pair[at] == code, self.pair_rank[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out = [[r] if (r := self.ranks.get(w)) is not None else [] for w in words]
        open_ = [i for i, w in enumerate(words) if w and not out[i]]
        for i in [i for i in open_ if len(words[i]) > LONG_WORD]:
            out[i] = self._one(words[i])
        open_ = [i for i in open_ if len(words[i]) <= LONG_WORD]
        if not open_:
            return out
        sizes = np.array([len(words[i]) for i in open_], np.int64)
        ends, n = np.cumsum(sizes), int(sizes.sum())
        token = self.bytes[np.frombuffer(b"".join(words[i] for i in open_), np.uint8)]
        left, right = np.arange(n) - 1, np.arange(n) + 1
        left[ends - sizes] = right[ends - 1] = -1
        due = np.append(self.rank_of(token[:-1], token[1:]), -1)
        due[ends - 1] = -1
        self._merge_all(token, left, right, due, np.repeat(np.arange(len(open_)), sizes))
        alive = token >= 0
        flat, stop = token[alive].tolist(), 0
        for i, size in zip(open_, sums_by(alive, sizes).tolist(), strict=True):
            out[i] = flat[stop : stop + size]
            stop += size
        return out

    def _merge_all(self, token: np.ndarray, left: np.ndarray, right: np.ndarray, due: np.ndarray, word: np.ndarray) -> None:
        """``due[i]`` is the rank of the pair that begins at place i now, -1 without one."""
        index: list[list[np.ndarray]] = [[] for _ in self.edges]

        def put(places: np.ndarray, least: int) -> list[np.ndarray]:
            """Places to their classes; those of classes up to ``least`` come back."""
            of = np.searchsorted(self.edges, due[places], "right") - 1
            order = np.argsort(of, kind="stable")
            kinds, starts = np.unique(of[order], return_index=True)
            now = []
            for kind, own in zip(kinds.tolist(), np.split(places[order], starts[1:]), strict=True) if len(kinds) else ():
                (now if kind <= least else index[kind]).append(own)
            return now

        put(np.flatnonzero(due >= 0), -1)
        for kind in range(len(index)):
            stop = self.edges[kind + 1] if kind + 1 < len(self.edges) else np.iinfo(np.int64).max
            places = np.unique(np.concatenate(index[kind])) if index[kind] else np.zeros(0, np.int64)
            while len(places):
                places = places[(due[places] >= 0) & (due[places] < stop)]
                if not len(places):
                    break
                order = np.lexsort((places, due[places], word[places]))
                places = places[order]
                first = np.append(True, np.diff(word[places]) != 0)
                i, rest = places[first], places[~first]
                j = right[i]
                after, before = right[j], left[i]
                token[i] = due[i]  # a token's id is its rank
                token[j] = due[j] = -1
                right[i] = after
                has = after >= 0
                left[after[has]] = i[has]
                due[i] = -1
                due[i[has]] = self.rank_of(token[i[has]], token[after[has]])
                some = before >= 0
                due[before[some]] = self.rank_of(token[before[some]], token[i[some]])
                new = np.concatenate([i, before[some]])
                places = np.unique(np.concatenate([rest, *put(new[due[new] >= 0], kind)]))

    def _one(self, word: bytes) -> list[int]:
        """A long word, place by place."""
        token, n = self.bytes[np.frombuffer(word, np.uint8)], len(word)
        due = [*self.rank_of(token[:-1], token[1:]).tolist(), -1]
        places: dict[int, list[int]] = {}
        for i, r in enumerate(due):
            if r >= 0:
                places.setdefault(r, []).append(i)
        token = token.tolist()
        self._replay(token, [i - 1 for i in range(n)], [*range(1, n), -1], due, places)
        return [t for t in token if t >= 0]

    def _replay(self, token: list[int], left: list[int], right: list[int], due: list[int], places: dict[int, list[int]]) -> None:
        """The same over lists, with the index in a heap of ranks."""
        heap, known, push = sorted(places), self.pairs, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            own = places.pop(r)
            own.sort()
            for done, i in enumerate(own, 1):
                if due[i] != r:
                    continue
                j = right[i]
                after, before, again = right[j], left[i], False
                token[i], token[j], due[j], right[i] = r, -1, -1, after
                q = -1
                if after >= 0:
                    left[after] = i
                    q = known.get(r << 32 | token[after], -1)
                    if q >= 0:
                        if q in places:
                            places[q].append(i)
                        else:
                            places[q] = [i]
                            push(heap, q)
                        again = q <= r
                due[i] = q
                if before >= 0:
                    q = due[before] = known.get(token[before] << 32 | r, -1)
                    if q >= 0:
                        if q in places:
                            places[q].append(before)
                        else:
                            places[q] = [before]
                            push(heap, q)
                        again |= q <= r
                if again:
                    rest = own[done:]
                    if r in places:
                        places[r] += rest
                    elif rest:
                        places[r] = rest
                        push(heap, r)
                    break


@functools.cache
def _replay_of(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


def _matches(unit: str, match) -> list[str]:
    """A space and ASCII letters are one match of any pattern that takes words with the space before them; others are searched."""
    return [unit] if unit[:1] == " " and unit[1:].isalpha() and unit.isascii() else match.findall(unit)


class UnitIds:
    """Units by number with the ids of each; words that ``head`` holds are looked up, the others' merges are replayed here."""

    def __init__(self, replay: MergeReplay, match, head: dict[str, list[int]]):
        self.replay, self.match, self.head, self.units = replay, match, head, Units()
        self.size = self.first = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def catch_up(self) -> None:
        """Encode the units that have come since the last time, so many at a time."""
        new, lo = self.units.texts(len(self.size)), 0
        while lo < len(new):
            hi, room = lo, BLOCK
            while hi < len(new) and (room > 0 or hi == lo):
                room -= len(new[hi])
                hi += 1
            words = Numbers()
            held = [list(map(words.__getitem__, _matches(u, self.match))) for u in new[lo:hi]]
            ids = [self.head.get(w) for w in words]
            rare = [w for w, known in zip(words, ids, strict=True) if known is None]
            replayed = iter(self.replay.encode([w.encode() for w in rare]))
            ids = [next(replayed) if known is None else known for known in ids]
            own = [ids[u[0]] if len(u) == 1 else [i for w in u for i in ids[w]] for u in held]
            size = np.fromiter(map(len, own), np.int64, len(own))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(own), np.int32, int(size.sum()))])
            lo = hi


def frequent_words(docs: DataFrame, ranks_path: str, pattern: str, text_col: str, most: int) -> DataFrame:
    """(word, ids) of at most ``most`` words that no token is, of 32 characters at most: those over the least frequency that keeps the bound.

    Tasks count the words of units that they have met more than once;
    frequencies only choose where a word is worked on, not its ids.
    """
    unit = unit_pattern()

    def counted(batches):
        import pyarrow as pa
        import regex

        ranks, match = _replay_of(ranks_path).ranks, regex.compile(pattern)
        units, times = Units(), np.zeros(0, np.int64)

        def words():
            count: dict[str, int] = {}
            for u, n in zip(units.texts(0), times.tolist(), strict=True):
                if n > 1:
                    for w in _matches(u, match):
                        count[w] = count.get(w, 0) + n
            found = [(w, n) for w, n in count.items() if len(w) <= 32 and w.encode() not in ranks]
            return pa.record_batch([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

        for _, _, texts in chunks(batches):
            seq, _ = numbered(texts, units, unit, spaced=False)
            more = np.bincount(seq, minlength=len(units))
            more[: len(times)] += times
            times = more
            if len(units) > MOST_UNITS:
                yield words()
                units, times = Units(), np.zeros(0, np.int64)
        yield words()

    def replayed(batches):
        import pyarrow as pa

        for batch in batches:
            ids = _replay_of(ranks_path).encode([w.encode() for w in batch.column(0).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string"))
    counts = settle(rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    scale = F.floor(F.log2("n") * 8).cast("int")  # eight classes an octave: some hundred rows
    classes = counts.groupBy(scale.alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect()
    least, room = None, most
    for r in classes:
        room -= r["n"]
        if room < 0:
            break
        least = r["class"]
    head = counts.where(F.lit(False) if least is None else scale >= least).select("word")
    head = settle(head.mapInArrow(replayed, "word string, ids array<int>"), "frequent-words")
    discard(counts)
    return head


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, *, frequent: int = 1 << 18, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` array<int>): each text's tokens, every match of ``pattern`` (a word) merged by itself; with ``decode`` also ``decoded``, the ids' bytes.

    All merges are replayed over many distinct words at once (``MergeReplay``):
    first, for the whole corpus, over its ``frequent`` most frequent words,
    whose ids are broadcast (at most 32 characters a word, so some 16 MB);
    then, in each task, over the distinct words left in what it has to do.
    Texts are numbered by units that words don't cross (``text_units``) and
    put together of the units' ids.  Only words and their counts are shuffled.
    The pattern must take a space and ASCII letters as one match, end a match
    wherever white space follows another character and before the last space
    in front of one, and look no further ahead than to a run's next character.

    ``ranks_path`` is read by the tasks and must be there on every machine.
    Null and empty texts have no ids; repeated rows give equal rows; null ids
    pass; texts of any length are worked on whole; other columns aren't read;
    an empty table gives an empty result.
    """
    unit = unit_pattern()
    head = frequent_words(docs, ranks_path, pattern, text_col, frequent)
    table = head.toArrow()  # ``frequent`` rows at most
    discard(head)
    held = docs.sparkSession.sparkContext.broadcast((table.column("word").to_pylist(), table.column("ids").to_pylist()))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))

    def encoded(batches):
        import pyarrow as pa
        import regex

        make = lambda: UnitIds(_replay_of(ranks_path), regex.compile(pattern), dict(zip(*held.value, strict=True)))
        known = make()
        for _, ids, texts in chunks(batches):
            if len(known.size) > MOST_UNITS:
                known = make()
            seq, sizes = numbered(texts, known.units, unit, spaced=False)
            known.catch_up()
            n = sums_by(known.size[seq], sizes)
            flat = known.flat[ragged(known.first[seq], known.size[seq])]
            back = [_decoder_of(ranks_path).decode(flat, n)] if decode else []
            yield pa.record_batch([ids, lists(flat, n), *back], names=["id", "ids", "decoded"][: 2 + len(back)])

    kinds = "id bigint, ids array<int>" + ", decoded binary" * decode
    return rows.mapInArrow(encoded, kinds).withColumnRenamed("id", id_col)


class Decoder:
    """The bytes of lists of ids."""

    def __init__(self, tokens: dict[int, bytes]):
        self.names = np.array(sorted(tokens), np.int64)
        self.size = np.array([len(tokens[i]) for i in self.names.tolist()], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens[i] for i in self.names.tolist()), np.uint8)

    def decode(self, flat: np.ndarray, counts: np.ndarray):
        """An Arrow array of the bytes of consecutive stretches of ids; an unknown id is an error."""
        import pyarrow as pa

        ends, parts, lo = np.cumsum(counts), [], 0
        while lo < len(counts):  # some lists at a time
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - counts[lo] + BLOCK // 4, "right")))
            own = flat[ends[lo] - counts[lo] : ends[hi - 1]]
            at = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
            if len(own) and not (self.names[at] == own).all():
                raise ValueError(f"ids that the vocabulary lacks: {own[self.names[at] != own][:5].tolist()}")
            stops = np.concatenate([[0], np.cumsum(sums_by(self.size[at], counts[lo:hi]))])
            parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(stops), pa.py_buffer(self.data[ragged(self.start[at], self.size[at])])]))
            lo = hi
        return pa.concat_arrays(parts).cast(pa.binary()) if parts else pa.array([], pa.binary())


@functools.cache
def _decoder_of(path: str) -> Decoder:
    return Decoder(_replay_of(path).tokens)


def decoded(ids: Column, ranks_path: str) -> Column:
    """The bytes of the tokens in an array column; a null array gives null, an unknown id or a null in it is an error."""

    @F.arrow_udf("binary")
    def decode(column):
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = column.flatten()
        if flat.null_count:
            raise ValueError("ids hold a null")
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = _decoder_of(ranks_path).decode(flat.to_numpy(zero_copy_only=False), counts)
        return pc.if_else(column.is_null(), pa.scalar(None, pa.binary()), out)

    return decode(ids)
