"""License scans by a generalised suffix automaton over template tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strideframe.llm.common import byte_texts
from strideframe.llm.license_texts import TEMPLATES

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<label:string,template:int,first_word:bigint,end_word:bigint,coverage:double>>"
)
# A-Z lower-cased, every other ASCII character that isn't a digit or a letter made a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def license_words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class SuffixAutomaton:
    """Of several token sequences; ``where[state]`` are (sequence, end) places of the state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.where: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.where[last].add((k, at + 1))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.where[self.link[state]] |= self.where[state]

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.where.append(set())
        return len(self.size) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state for the strings of ``q`` that end p's extension: q itself, or a clone of the right length."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # another sequence has been here
            return self._split(last, token, self.next[last][token])
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new

    def statistics(self, tokens):
        """Per token: (length, state) of the longest match that ends there."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            else:
                state = length = 0
            yield length, state


class LicenseScanner:
    def __init__(self, templates, phrases, min_match: int, max_gap: int, min_cover: float):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in license_words(text.encode())]
        self.labels = [label for label, _ in templates]
        self.sequences = [number(text) for _, text in templates]
        self.phrases = [(label, license_words(text.encode())) for text, label in phrases.items()]
        self.automaton = SuffixAutomaton(self.sequences)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.shortest = min([min_match, *(len(x) for x in self.sequences if x)])  # a shorter run of known words matches nothing
        sizes = [len(x) for x in self.sequences]
        self.places = [sorted((k, stop) for k, stop in places if sizes[k] >= min_match) for places in self.automaton.where]
        self.whole: list[tuple[int, ...]] = [()] * len(self.places)  # templates of fewer words that a state's longest string ends with
        for state in sorted(range(1, len(self.places)), key=self.automaton.size.__getitem__):
            own = tuple(k for k, stop in self.automaton.where[state] if stop == sizes[k] < min_match and self.automaton.size[self.automaton.link[state]] < stop <= self.automaton.size[state])
            self.whole[state] = self.whole[self.automaton.link[state]] + own
        self.automaton.where = []

    def base(self, ws: list[bytes]) -> list[tuple[int, str]]:
        found = []
        for label, phrase in self.phrases:
            first, k, at = phrase[0], len(phrase), -1
            while True:
                try:
                    at = ws.index(first, at + 1)
                except ValueError:
                    break
                if ws[at : at + k] == phrase:
                    found.append((at, label))
        return found

    def matches(self, ws: list[bytes]):
        """(end word, length, template, template end): at each place of a template the longest match of ``min_match`` words or more that doesn't go on, and each shorter template as a whole."""
        get, link, size = self.vocabulary.get, self.automaton.link, self.automaton.size
        run: list[int] = []

        def walk(last: int):
            if len(run) < self.shortest:
                return
            for j, (length, state) in enumerate(self.automaton.statistics(run)):
                end, after = last - len(run) + j + 1, run[j + 1] if j + 1 < len(run) else -1
                for k in self.whole[state]:
                    if (n := len(self.sequences[k])) <= length:
                        yield end, n, k, n
                seen: set[tuple[int, int]] = set()
                while length >= self.min_match:  # the state's places, then those of ever shorter matches
                    for place in self.places[state]:
                        if place not in seen:
                            seen.add(place)
                            k, stop = place
                            if stop == len(self.sequences[k]) or self.sequences[k][stop] != after:
                                yield end, length, k, stop
                    state = link[state]
                    length = size[state]

        for i, w in enumerate(ws):
            if (t := get(w)) is not None:
                run.append(t)
            elif run:
                yield from walk(i)
                run.clear()
        if run:
            yield from walk(len(ws))

    def spans(self, ws: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        """Of each template the chains of matches, in template order with gaps of ``max_gap`` words at most, that cover enough of it.

        A match goes on the chain that covers most of those it can follow (then
        the latest); it may also be followed in several ways, so no choice is
        lost.  Of chains that overlap in the text, the one that covers most
        stays, then the shortest, then the first.
        """
        chains: dict[int, list[tuple[int, int, int, int]]] = {}  # template: (first word, end word, template end, covered) of each match's best chain
        near: dict[int, list[tuple[int, int, int, int]]] = {}  # those that a later match can still follow: ends only grow
        for end, length, k, stop in self.matches(ws):
            at, begin = end - length, stop - length
            mine = near[k] = [c for c in near.get(k, ()) if c[1] + self.max_gap + len(self.sequences[k]) >= end]
            before = max((c for c in mine if 0 <= at - c[1] <= self.max_gap and c[2] <= begin), key=lambda c: (c[3], c[1], c[0]), default=None)
            own = (before[0], end, stop, before[3] + length) if before else (at, end, stop, length)
            mine.append(own)
            if own[3] >= self.min_cover * len(self.sequences[k]):
                chains.setdefault(k, []).append(own)
        out = []
        for k, mine in chains.items():
            taken: list[tuple[int, int]] = []
            for first, end, _, covered in sorted(mine, key=lambda c: (-c[3], c[1] - c[0], c[0])):
                if all(end <= a or b <= first for a, b in taken):
                    taken.append((first, end))
                    out.append((self.labels[k], k, first, end, min(1.0, covered / len(self.sequences[k]))))
        return sorted(out, key=lambda x: (x[2], x[3], x[1]))


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    *,
    min_match: int = 5,
    max_gap: int = 4,
    min_cover: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence labels of each document.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of any
    character from U+0080.  ``phrases`` found word for word give ``n_base``
    places and ``base_labels``.  The templates, given by the caller, form one
    suffix automaton of at most twice their words, which is broadcast; each
    text streams through it, the longest matches that can't be extended (``min_match`` words, or a whole
    shorter template) are chained (``LicenseScanner.spans``), and a chain that covers ``min_cover`` of a
    template is a span.  ``labels`` are the base labels and the spans' labels;
    ``score`` is 1 with a base label, else the best coverage, else 0.

    Chains of different templates may overlap, and each is a span; spans of
    one template don't.  Null and empty texts have no words; repeated
    rows give equal rows; texts of any length are scanned whole; other columns
    aren't read; an empty table gives an empty result.  No shuffle.
    """
    scanner = LicenseScanner(templates or TEMPLATES, phrases or PHRASES, min_match, max_gap, min_cover)
    held = docs.sparkSession.sparkContext.broadcast(scanner)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def one(raw: bytes):
        scan = held.value
        ws = license_words(raw)
        base, spans = scan.base(ws), scan.spans(ws)
        base_labels = {label for _, label in base}
        labels = base_labels | {s[0] for s in spans}
        starts = [at for at, _ in base]
        return (
            len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)),
            1.0 if base else max((s[4] for s in spans), default=0.0),
            [dict(zip(("label", "template", "first_word", "end_word", "coverage"), s, strict=True)) for s in spans],
        )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [one(raw) for raw in byte_texts(part.column(1))]
                columns = [part.column(0), *(list(zip(*out, strict=True)) or [[]] * 8)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
