"""Texts as numbers of their units: the part that byte-level coding and tokenizer alignment share.

Units are stretches of a text that no token of these tokenizers crosses, so
that a task works on each distinct one once.  They are mostly a space and what
stands up to the next one; where white space stands together in other ways,
a text is cut only where white space follows another character.
"""

from __future__ import annotations

import re
import uuid
from itertools import islice

import numpy as np

from strideframe.llm.common import text_blocks

CHUNK = 4 << 20  # bytes of text that are worked on together
MOST_UNITS = 1 << 18  # from which on a task begins to number them anew
# The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_BEGINS, _ENDS, _EMPTY = 1, 2, 4


def unit_pattern(no_cut: str = "") -> re.Pattern[str]:
    """Cuts a text wherever white space follows another character; not before the white space in ``no_cut``."""
    s, n, u = f"[{WHITE}]", f"[^{WHITE}]", f"[{no_cut}]" if no_cut else "(?!)"
    return re.compile(f"{s}*+(?:{n}++(?:{u}{s}*+)?+)++|{s}++")


class Numbers(dict):
    """Numbers keys in order of appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Units(Numbers):
    """Units by number: a string is a unit without the space that it begins with, a tuple of one string is a unit as it is."""

    def __init__(self):
        self.edges = np.zeros(0, np.uint8)

    def texts(self, first: int) -> list[str]:
        """The units from number ``first`` on."""
        return [" " + k if type(k) is str else k[0] for k in islice(self, first, None)]

    def marked(self) -> np.ndarray:
        """Of each unit: whether what follows its space begins or ends with white space, or is nothing."""
        new = [k if type(k) is str else k[0] for k in islice(self, len(self.edges), None)]
        more = [_BEGINS * (k[0] in WHITE) + _ENDS * (k[-1] in WHITE) if k else _EMPTY for k in new]
        self.edges = np.concatenate([self.edges, np.array(more, np.uint8)])
        return self.edges


def numbered(texts: list[str], units: Units, pattern: re.Pattern[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each text's units as numbers, one text after another, and how many each has; ``spaced`` puts a space before each text that isn't empty.

    A text is cut before each space.  Where spaces stand together or at an end,
    or white space stands on both sides of one, it is cut by ``pattern``
    instead, as a tokenizer may take white space that stands together as one.
    """
    number, parts = units.__getitem__, []
    for text in texts:
        pieces = text.split(" ") if text else []
        parts.append(np.array(list(map(number, pieces)) if spaced or not pieces else [number((pieces[0],)), *map(number, pieces[1:])], np.int32))
    sizes = np.array([len(p) for p in parts], np.int64)
    seq = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    edges = units.marked()[seq]
    beside = np.zeros(len(seq), bool)
    beside[1:] = (edges[1:] & _BEGINS > 0) & (edges[:-1] & _ENDS > 0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    beside[first] = False
    odd = np.flatnonzero(sums_by((edges & _EMPTY > 0) | beside, sizes))
    for i in odd.tolist():
        parts[i] = np.array([number((u,)) for u in pattern.findall(f" {texts[i]}" if spaced else texts[i])], np.int32)
        sizes[i] = len(parts[i])
    return (np.concatenate(parts) if len(odd) else seq), sizes


def chunks(batches, most_bytes: int = CHUNK):
    """(chunk id, ids as an Arrow array, texts) of Arrow batches of ids and texts; the id is random, so the rows made of a chunk are stored before they are read twice."""
    for batch in batches:
        for at, raws in text_blocks(batch.column(1), most_bytes):
            yield uuid.uuid4().int >> 65, batch.column(0).slice(at, len(raws)), [x.decode() for x in raws]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def sums_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def lists(values: np.ndarray, sizes: np.ndarray):
    """An Arrow array of lists of ``values``."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
