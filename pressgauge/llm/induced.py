"""Suffix sorting with common prefixes by external induction.

The suffixes of a text are sorted by inducing: a suffix is placed when the one behind it is, at the
end of the part of its first symbol. What is to be placed stands in one queue for each symbol; as it
arrives in order, reading the queues symbol by symbol takes out the least first, so together they are
a priority queue. Its tuples (place, common prefix with the one before) are taken and put in blocks,
and go to a file beyond HELD tuples; memory holds the text, its types and a block.

The steps: sort the pieces between leftmost smaller suffixes by a first induction, name them, order
the string of names (by doubling), and induce all suffixes from that order, first those that are
larger than their successor, then the smaller ones. Common prefixes are found for the seeds and
carried on: that of two suffixes is one more than the least between the two they come from. They
are counted to CAP.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 255
#: Tuples that all queues of a sort hold in memory before they go on to files, and tuples in a block.
HELD, BLOCK = 1 << 23, 1 << 20


class Queue:
    """First in, first out: pairs of arrays (places int64, prefixes uint8). Old parts lie in a file."""

    def __init__(self, room: list[int]):
        self.room = room  # what all queues may still hold
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.file, self.stored, self.taken, self.length = None, [], 0, 0

    def put(self, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.length += len(places)
        if self.room[0] < len(places):
            self._spill()
        self.room[0] -= len(places)
        self.parts.append((places, prefixes))

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # the task's own, gone with it
        for places, prefixes in self.parts:
            self.file.seek(0, 2)
            self.stored.append((self.file.tell(), len(places)))
            self.file.write(places.tobytes())
            self.file.write(prefixes.tobytes())
            self.room[0] += len(places)
        self.parts = []

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest parts, about a block of them, or nothing."""
        if self.taken < len(self.stored):
            at, n = self.stored[self.taken]
            self.taken += 1
            self.file.seek(at)
            return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)
        if not self.parts:
            return None
        n = total = 0
        while n < len(self.parts) and total < BLOCK:
            total += len(self.parts[n][0])
            n += 1
        taken, self.parts = self.parts[:n], self.parts[n:]
        self.room[0] += total
        return taken[0] if n == 1 else (np.concatenate([p[0] for p in taken]), np.concatenate([p[1] for p in taken]))

    def whole(self, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All parts without taking them, the newest first if ``back``."""
        order = [(self._stored, i) for i in range(len(self.stored))] + [(self.parts.__getitem__, i) for i in range(len(self.parts))]
        for get, i in reversed(order) if back else order:
            yield get(i)

    def _stored(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = self.stored[i]
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)


class _Least:
    """Least values of ranges of one array: by powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo:hi], all of these not empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.flatnonzero(np.bincount(level)).tolist():
            at = np.flatnonzero(level == k)
            values = self.levels[k]
            out[at] = np.minimum(values[lo[at]], values[hi[at] - (1 << k)])
        return out


class Sorter:
    """``text``: uint16 symbols, the last one 0 and the only 0."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        self.symbols = int(text.max()) + 1
        change = np.flatnonzero(np.diff(text.astype(np.int32)))
        ends = np.append(change, n - 1)  # of runs of one symbol
        run = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
        after = text[np.minimum(run + 1, n - 1)]
        self.larger = after < text  # than the suffix behind it
        self.larger[n - 1] = False
        self.run = np.minimum(run - np.arange(n) + 1, CAP).astype(np.uint8)
        self.smaller = ~self.larger
        self.seeds = np.flatnonzero(~self.larger[1:] & self.larger[:-1]) + 1

    def _push(self, queues: list[Queue], wanted: np.ndarray, least: np.ndarray | None, places: np.ndarray, prefixes: np.ndarray) -> None:
        """Queue the suffixes one longer than those of a block, if ``wanted``."""
        at = np.flatnonzero((places > 0) & wanted[places - 1])
        if least is not None:
            total = prefixes.min() if len(prefixes) else CAP
        if len(at):
            longer = places[at] - 1
            symbol = self.text[longer]
            order = np.argsort(symbol, kind="stable")
            longer, symbol, at = longer[order], symbol[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            ends = np.append(starts[1:], len(symbol))
            common = np.zeros(len(at), np.uint8)
            if least is not None:
                found = _Least(prefixes)
                lo = np.concatenate([[0], at[:-1] + 1])
                lo[starts] = 0
                common = found.between(lo, at + 1)
                common[starts] = np.minimum(common[starts], least[symbol[starts]])
                common = np.minimum(common, CAP - 1) + np.uint8(1)
                np.minimum(least, total, out=least)
                tail = np.minimum.accumulate(prefixes[::-1])[::-1]
                last = at[ends - 1] + 1
                least[symbol[starts]] = np.where(last < len(tail), tail[np.minimum(last, len(tail) - 1)], CAP)
            for a, b in zip(starts.tolist(), ends.tolist()):
                queue = queues[symbol[a]]
                if not queue.length:
                    common[a] = 0
                queue.put(longer[a:b], common[a:b])
        elif least is not None:
            np.minimum(least, total, out=least)

    def _induce(self, seeds: np.ndarray, prefixes: np.ndarray, common: bool) -> tuple[list[Queue], list[Queue]]:
        """Sorted larger suffixes by symbol, ascending, and sorted smaller ones, descending."""
        room = [HELD]
        larger, done = ([Queue(room) for _ in range(self.symbols)] for _ in range(2))
        least = np.full(self.symbols, CAP, np.uint8) if common else None
        bounds = np.searchsorted(self.text[seeds], np.arange(self.symbols + 1))
        for c in range(self.symbols):
            last = -1
            while (part := larger[c].take()) is not None:
                for at in range(0, len(part[0]), BLOCK):
                    places, carried = part[0][at : at + BLOCK], part[1][at : at + BLOCK]
                    done[c].put(places, carried)
                    self._push(larger, self.larger, least, places, carried)
                    last = places[-1]
            for at in range(bounds[c], bounds[c + 1], BLOCK):
                places = seeds[at : min(at + BLOCK, bounds[c + 1])]
                carried = prefixes[at : at + len(places)].copy()
                if at == bounds[c]:
                    carried[0] = min(self.run[last], self.run[places[0]]) if last >= 0 else 0
                self._push(larger, self.larger, least, places, carried)
        room = [HELD]
        smaller, placed = ([Queue(room) for _ in range(self.symbols)] for _ in range(2))
        least = np.full(self.symbols, CAP, np.uint8) if common else None
        for c in range(self.symbols - 1, -1, -1):
            last = -1
            if c == 0:
                smaller[0].put(np.array([len(self.text) - 1]), np.zeros(1, np.uint8))
            while (part := smaller[c].take()) is not None:
                for at in range(0, len(part[0]), BLOCK):
                    places, carried = part[0][at : at + BLOCK], part[1][at : at + BLOCK]
                    placed[c].put(places, carried)
                    self._push(smaller, self.smaller, least, places, carried)
                    last = places[-1]
            behind = 0 if last < 0 else None
            for places, carried in done[c].whole(back=True):
                places = places[::-1]
                if behind is None:
                    behind = min(self.run[last], self.run[places[0]])
                shifted = np.concatenate([[behind], carried[:0:-1]]).astype(np.uint8)
                behind = carried[0]
                self._push(smaller, self.smaller, least, places, shifted)
        return done, placed

    def _common(self, left: np.ndarray, right: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Equal symbols from each pair of places, ``most`` at most."""
        n = len(self.text)
        out = np.zeros(len(left), np.int64)
        most = np.minimum(np.broadcast_to(most, left.shape), n - np.maximum(left, right))
        open_ = np.flatnonzero(out < most)
        padded = np.concatenate([self.text, np.zeros(4, np.uint16)])
        packed = np.ndarray((n,), "<u8", padded.data, strides=(2,))  # four symbols from each place
        while len(open_):
            a, b, done = left[open_], right[open_], out[open_]
            change = packed[a + done] ^ packed[b + done]
            same = np.bitwise_count((change & (~change + np.uint64(1))) - np.uint64(1)) >> 4  # before the first that differs
            step = np.minimum(np.where(change == 0, 4, same), most[open_] - done)
            out[open_] += step
            open_ = open_[(step == 4) & (out[open_] < most[open_])]
        return out

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (places, common prefix with the suffix before), least suffix first."""
        seeds = self.seeds
        if len(seeds) > 1:
            by_symbol = seeds[np.argsort(self.text[seeds], kind="stable")]
            _, placed = self._induce(by_symbol, np.zeros(len(seeds), np.uint8), False)
            is_seed = np.zeros(len(self.text), bool)
            is_seed[seeds] = True
            order = np.concatenate([p[0][is_seed[p[0]]] for q in placed[::-1] for p in q.whole()])[::-1]
            number = np.zeros(len(self.text), np.int64)
            number[seeds] = np.arange(len(seeds))
            index = number[order]
            length = np.append(np.diff(seeds) + 1, 1)[index]  # of the piece up to the next seed
            equal = length[1:] == length[:-1]
            at = np.flatnonzero(equal)
            equal[at] = self._common(order[at], order[at + 1], length[at]) == length[at]
            names = np.empty(len(seeds), np.int64)
            names[index] = np.concatenate([[0], np.cumsum(~equal)])
            seeds = seeds[_order_of(names)]
        prefixes = np.zeros(len(seeds), np.uint8)
        if len(seeds) > 1:
            prefixes[1:] = self._common(seeds[:-1], seeds[1:], CAP)
        done, placed = self._induce(seeds, prefixes, True)
        for c in range(self.symbols):
            last = -1
            for places, carried in done[c].whole():
                yield places, carried
                last = places[-1]
            behind = None
            for places, carried in placed[c].whole(back=True):
                if behind is None:
                    behind = min(self.run[last], self.run[places[-1]]) if last >= 0 else 0
                yield places[::-1], np.concatenate([[behind], carried[:0:-1]]).astype(np.uint8)
                behind = carried[0]


def _order_of(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of numbers, by doubling the length that is known."""
    n, step = len(names), 1
    while True:
        if names.max() == n - 1:
            order = np.empty(n, np.int64)
            order[names] = np.arange(n)
            return order
        behind = np.zeros(n, np.int64)
        behind[: n - step] = names[step:] + 1
        keys = names * (n + 2) + behind
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        names = np.empty(n, np.int64)
        names[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        step *= 2
