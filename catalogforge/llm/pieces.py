"""Token ids of many texts through a library that encodes each distinct piece once.

Texts are cut at blanks that no token crosses. The distinct pieces of a slice are looked up
in a table of those met before; what is new goes to the library in one call, and the ids of
all texts are gathered from the table by array operations. Where every blank is a cut, Arrow
cuts and finds the distinct pieces; only those become Python strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters of text taken at a time, and bytes that the table of pieces may hold.
SEGMENT = 2 << 20
MEMORY = 80 << 20
# Longer pieces are not remembered, though their ids take memory until the table starts afresh.
LONGEST = 64
# What a remembered piece takes besides its letters and ids.
ENTRY = 160

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK_RUN = re.compile(r" (?:\s|\Z)")
BORDER = re.compile(r" (?=\S)")
AFTER_TEXT = re.compile(r"(?<=[^ ]) ")

# So many new pieces at most go to the library joined.
JOINED = 4000

# Ids of each text of a list.
Encode = Callable[[list[str]], list[list[int]]]


def byte_level(text: str) -> list[str]:
    """Cut at blanks before a non-blank, as byte-level pre-tokens are; later pieces lack theirs."""
    return BORDER.split(text) if BLANK_RUN.search(text) else text.split(" ")


def after_text(text: str) -> list[str]:
    """Cut at blanks after a non-blank, where no run of blanks is cut."""
    return AFTER_TEXT.split(text) if text.startswith(" ") or "  " in text else text.split(" ")


def single_blanks(text: str) -> bool:
    """Whether both of the above cut at every blank."""
    return not (text.startswith(" ") or BLANK_RUN.search(text))


def segments(text: str) -> Iterator[str]:
    """The text in parts of about ``SEGMENT`` characters, cut at single blanks between words.

    A longer part is one that has no such blank.
    """
    at = 0
    while len(text) - at > SEGMENT:
        found = SAFE_CUT.search(text, at + SEGMENT)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


class Known(dict):
    """Places of pieces in a table of ``places``; those that it lacks are listed as ``fresh``."""

    def __init__(self, pieces: Iterable[str | tuple[str]] = ()):
        super().__init__((p, i) for i, p in enumerate(pieces))
        self.fresh: list[str | tuple[str]] = []
        self.places = len(self)

    def __missing__(self, piece: str | tuple[str]) -> int:
        place = self.places + len(self.fresh)
        self.fresh.append(piece)
        if len(piece) <= LONGEST:
            self[piece] = place
        return place


class Pieces:
    """Ids of texts by ``encode``, which gets pieces with the blank before them.

    ``blank`` says of each id whether it begins with a blank: new pieces are encoded joined,
    and those ids tell where one ends. ``lead``: a text begins with a blank of its own, so its
    first piece is like the others. ``check``: what of each new piece's ids to remember, such
    as whether they spell it.
    """

    def __init__(
        self,
        encode: Encode,
        split: Callable[[str], list[str]],
        blank: np.ndarray,
        lead: bool,
        check: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray] | None = None,
        memory: int = MEMORY,
    ):
        self.library, self.split, self.blank = encode, split, blank
        self.lead, self.check, self.memory = lead, check, memory
        self._forget()

    def _forget(self) -> None:
        # First pieces without a blank are kept apart as tuples.
        self.known, self.held = Known(), 0
        self.values, self.good = np.zeros(0, np.int32), np.zeros(0, bool)
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _trim(self) -> None:
        """Keeps the pieces met more than once since the last time, if they are few enough."""
        kept = [(p, i) for p, i in self.known.items() if self.uses[i] > 1]
        pieces, places = [p for p, _ in kept], np.array([i for _, i in kept], np.int64)
        starts, sizes, good, values = self.starts[places], self.sizes[places], self.good[places], self.values
        self._forget()
        if 2 * (ENTRY * len(kept) + 4 * int(sizes.sum())) < self.memory:
            self.known = Known(pieces)
            self._add(pieces, spread(values, starts, sizes), sizes, good)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each text has, and whether ``check`` held for all its pieces."""
        values, sizes, good = [], [], []
        # Of each part: its text, its first piece where that has no blank, and its other pieces,
        # as a list or, if they are what lies between blanks, still as one string.
        parts: list[tuple[int, tuple[str] | None, str | list[str] | None]] = []
        length = 0

        def flush() -> None:
            nonlocal parts, length
            if parts:
                index, counts = self._places(parts)
                found, lengths, fine = self._look_up(index)
                ends = np.cumsum(counts)
                total = np.concatenate([[0], np.cumsum(lengths)])
                bad = np.concatenate([[0], np.cumsum(~fine)])
                for (owner, _, _), a, b in zip(parts, ends - counts, ends, strict=True):
                    sizes[owner] += int(total[b] - total[a])
                    good[owner] = good[owner] and not bad[b] - bad[a]
                values.append(found)
            parts, length = [], 0

        for owner, text in enumerate(texts):
            sizes.append(0)
            good.append(True)
            for number, part in enumerate(segments(text)):
                head, rest = None, part
                if not single_blanks(part):
                    rest = self.split(part)
                    if not number and not self.lead:
                        head, rest = (rest[0],), rest[1:]
                elif not number and not self.lead:
                    first, blank, after = part.partition(" ")
                    head, rest = (first,), after if blank else None
                parts.append((owner, head, rest))
                length += len(part)
                if length >= SEGMENT:
                    flush()
        flush()
        joined = np.concatenate(values) if values else np.zeros(0, np.int32)
        return joined, np.array(sizes, np.int64), np.array(good, bool)

    def _places(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of all pieces of some parts, and how many each part has."""
        place = self.known.__getitem__
        cut = [rest for _, _, rest in parts if rest.__class__ is list]
        uncut = [rest for _, _, rest in parts if rest.__class__ is str]
        pieces = pc.split_pattern(pa.array(uncut, pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        # No piece holds a blank, so this makes strings of them in one step.
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        words = pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if uncut else []
        later = np.fromiter(map(place, words), np.int64, len(words))[coded.indices.to_numpy()]
        other = np.fromiter((place(p) for rest in cut for p in rest), np.int64, sum(map(len, cut)))
        heads = [head for _, head, _ in parts if head]
        kind = np.array([2 * (r.__class__ is list) + (r.__class__ is str) for _, _, r in parts], np.int8)
        begun = np.array([bool(head) for _, head, _ in parts])
        counts = begun.astype(np.int64)
        counts[kind == 1] += pc.list_value_length(pieces).to_numpy()
        counts[kind == 2] += np.fromiter(map(len, cut), np.int64, len(cut))
        index, kinds = np.empty(int(counts.sum()), np.int64), np.repeat(kind, counts)
        firsts = (np.cumsum(counts) - counts)[begun]
        kinds[firsts] = 0
        index[firsts] = np.fromiter(map(place, heads), np.int64, len(heads))
        index[kinds == 1], index[kinds == 2] = later, other
        return index, counts

    def _look_up(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces at ``index``, how many each has, and what is remembered of it."""
        if fresh := self.known.fresh:
            bare = [i for i, p in enumerate(fresh) if p.__class__ is tuple]
            spelled = [" " + p if p.__class__ is str else p[0] for p in fresh]
            values, sizes = self._encoded(spelled, bare)
            good = np.ones(len(fresh), bool) if self.check is None else self.check(spelled, values, sizes)
            self._add(spelled, values, sizes, good)
            self.known.places += len(fresh)
            self.known.fresh = []
        self.uses += np.bincount(index, minlength=len(self.uses))
        lengths, fine = self.sizes[index], self.good[index]
        out = spread(self.values, self.starts[index], lengths)
        if self.held > self.memory:
            self._trim()
        return out, lengths, fine

    def _add(self, pieces: list, values: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> None:
        """New rows at the end of the table."""
        start = len(self.values)
        self.values = np.concatenate([self.values, values])
        self.starts = np.concatenate([self.starts, start + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.good = np.concatenate([self.good, good])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.held += ENTRY * len(pieces) + 4 * len(values) + sum(map(len, pieces))

    def _encoded(self, spelled: list[str], bare: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces: joined where one blank stands before text and nowhere else.

        ``bare`` are the places of pieces without the blank before them.
        """
        stops = sorted({*range(0, len(spelled), JOINED), *bare, *(i + 1 for i in bare), len(spelled)})
        runs: list[list[str]] = []
        for a, b in pairwise(stops):
            run = spelled[a:b]
            text = "".join(run)
            if b - a > 1 and (text.count(" ") != b - a or BLANK_RUN.search(text)):
                runs += [[p] for p in run]
            else:
                runs.append(run)
        ids = [np.array(x, np.int32) for x in self.library(["".join(r) for r in runs])]
        sizes: list[np.ndarray] = []
        for at, (run, found) in enumerate(zip(runs, ids, strict=True)):
            if len(run) == 1:
                sizes.append(np.array([len(found)]))
                continue
            starts = np.flatnonzero(self.blank[found])
            if len(starts) == len(run) and starts[0] == 0:
                sizes.append(np.diff(starts, append=len(found)))
            else:
                single = self.library(run)
                sizes.append(np.fromiter(map(len, single), np.int64, len(single)))
                ids[at] = np.array([i for x in single for i in x], np.int32)
        none = [np.zeros(0, np.int32)]
        return np.concatenate(ids or none), np.concatenate(sizes or none).astype(np.int64)


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """``values[start : start + length]`` of each pair, one after the other, some pairs at a time."""
    out = np.empty(int(lengths.sum()), values.dtype)
    filled = 0
    for at in range(0, len(lengths), block):
        first, size = starts[at : at + block], lengths[at : at + block]
        ends = np.cumsum(size)
        n = int(ends[-1])
        out[filled : filled + n] = values[np.arange(n) + np.repeat(first - (ends - size), size)]
        filled += n
    return out
