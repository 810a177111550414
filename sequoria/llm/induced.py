"""External induced sorting of suffixes with their common prefixes, for one task's shard.

The text, the queues and the sorted L-type suffixes lie in files of a folder; memory holds
blocks. Suffixes leave a disk-backed priority queue in sorted order, each as a tuple (place,
common prefix with the one before), and each induces the suffix one place to its left. The
suffixes that nothing induces are sorted by recursion on the names of the substrings
between them.

Common prefixes are cut at MOST_COMMON; the caller asks for an order that is right for
``need`` characters, and ties beyond may stand in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: A text has a zero at least every MOST_COMMON - 1 characters, so no common prefix of interest is cut.
MOST_COMMON = 255
Block = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Room:
    """``rows``: tuples that stay in memory; ``base``: names that are sorted in memory rather than by recursion.

    ``folder``: where the task spills (its own temporary folder by default). These files have
    no name, serve this task only and go with it; a task that is run again makes them anew.
    """

    folder: str | None = None
    rows: int = 1 << 18
    base: int = 1 << 22

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.rows:
            return np.empty(n, dtype)
        handle, path = tempfile.mkstemp(dir=self.folder)
        os.close(handle)
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)
        return out


class Queue:
    """A priority queue of tuples by (character, arrival); what does not fit in memory waits in a file.

    Induction only adds characters that are still to come or the one that is being taken
    out, so tuples of one character are a sequence of pieces and nothing is ever sorted anew.
    """

    def __init__(self, room: Room):
        self.most, self.pieces, self.rows, self.folder, self.file = room.rows, {}, 0, room.folder, None

    def push(self, chars: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        """Tuples whose characters do not fall."""
        if not len(chars):
            return
        cuts = [0, *(np.flatnonzero(chars[1:] != chars[:-1]) + 1).tolist(), len(chars)]
        for a, b in zip(cuts, cuts[1:]):
            self.pieces.setdefault(int(chars[a]), []).append((place[a:b], common[a:b]))
        self.rows += len(chars)
        if self.rows > self.most:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(dir=self.folder)
        for pieces in self.pieces.values():
            for k, piece in enumerate(pieces):
                if not isinstance(piece[0], int):
                    at = self.file.seek(0, os.SEEK_END)
                    self.file.write(np.ascontiguousarray(piece[0], np.int64).tobytes())
                    self.file.write(np.ascontiguousarray(piece[1], np.uint8).tobytes())
                    pieces[k] = (at, len(piece[0]))
        self.rows = 0

    def _read(self, piece) -> Block:
        if not isinstance(piece[0], int):
            self.rows -= len(piece[0])
            return piece
        at, n = piece
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)

    def pop(self, char: int) -> Block | None:
        """The next tuples of a character, a block of them at most."""
        pieces = self.pieces.get(char)
        if not pieces:
            self.pieces.pop(char, None)
            return None
        n = used = 0
        for piece in pieces:
            n += piece[1] if isinstance(piece[0], int) else len(piece[0])
            used += 1
            if n > self.most:
                break
        blocks = [self._read(p) for p in pieces[:used]]
        del pieces[:used]
        return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])


class Sorted:
    """Blocks of tuples by character, to be read backwards."""

    def __init__(self, room: Room):
        self.queue = Queue(room)

    def append(self, char: int, block: Block) -> None:
        self.queue.push(np.full(len(block[0]), char), *block)

    def backwards(self, char: int) -> Iterator[Block]:
        pieces = self.queue.pieces.pop(char, [])
        for piece in reversed(pieces):
            yield self.queue._read(piece)


class RangeMin:
    """Least value of ranges, by tables of ranges of 1, 2, 4... values."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        top = int(level.max(initial=0))
        while len(self.tables) <= top:
            half, last = 1 << len(self.tables) - 1, self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))
        out = np.empty(len(begin), self.tables[0].dtype)
        for k in range(top + 1):
            m = level == k
            if m.any():
                out[m] = np.minimum(self.tables[k][begin[m]], self.tables[k][end[m] - (1 << k)])
        return out


def _induce(text: np.ndarray, block: Block, wanted: Callable[[np.ndarray], np.ndarray], lately: dict[int, int], queue: Queue) -> None:
    """Push the suffixes left of a block's; ``lately``: the least common prefix since a character's last push from this bucket."""
    place, common = block
    before = text[np.maximum(place - 1, 0)]
    chosen = np.flatnonzero((place > 0) & wanted(before))
    whole, earlier = int(common.min()), dict(lately)
    for c in lately:
        lately[c] = min(lately[c], whole)
    if not len(chosen):
        return
    chars = before[chosen]
    order = np.argsort(chars, kind="stable")
    chars, chosen = chars[order], chosen[order]
    new = np.concatenate([[True], chars[1:] != chars[:-1]])
    least = np.zeros(len(chosen), dtype=np.uint8)
    old = np.flatnonzero(~new)
    if len(old):
        least[old] = RangeMin(common).of(chosen[old - 1] + 1, chosen[old] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    from_start = np.minimum.accumulate(common)
    to_end = np.concatenate([np.minimum.accumulate(common[::-1])[::-1], [MOST_COMMON]])
    for a, b, c in zip(first.tolist(), last.tolist(), chars[first].tolist()):
        # another bucket's suffix begins with another character
        least[a] = min(earlier[c], int(from_start[chosen[a]])) if c in earlier else 0
        lately[c] = int(to_end[chosen[b] + 1])
    queue.push(chars, place[chosen] - 1, np.minimum(least, MOST_COMMON - 1) + np.uint8(1))


def _run_length(text: np.ndarray, place: int) -> int:
    k, c = 1, text[place]
    while k < MOST_COMMON and place + k < len(text) and text[place + k] == c:
        k += 1
    return k


def _boundary(text: np.ndarray, a: int, b: int) -> int:
    """Common prefix of an L-type and an S-type suffix of one character."""
    return min(_run_length(text, a), _run_length(text, b))


def _with_first(block: Block, value: int) -> Block:
    common = block[1].copy()
    common[0] = value
    return block[0], common


def _l_phase(text: np.ndarray, size: int, seeds: Block, room: Room) -> Sorted:
    """The L-type suffixes, sorted, from S* suffixes in order (with the common prefix of neighbours)."""
    queue, out = Queue(room), Sorted(room)
    place, common = seeds
    at = 0
    for c in range(size):
        lately: dict[int, int] = {}
        last = -1
        while (block := queue.pop(c)) is not None:
            if last < 0:
                block = _with_first(block, 0)
            out.append(c, block)
            _induce(text, block, lambda x: x >= c, lately, queue)
            last = int(block[0][-1])
        new = True
        while at < len(place):
            part = place[at : at + room.rows]
            n = len(part) if text[part[-1]] == c else int(np.searchsorted(text[part], c, side="right"))
            if not n:
                break
            block = np.asarray(part[:n]), np.asarray(common[at : at + n])
            if new:
                block = _with_first(block, 0 if last < 0 else _boundary(text, last, int(block[0][0])))
            _induce(text, block, lambda x: x > c, lately, queue)
            new, at = False, at + n
            if n < len(part):
                break
    return out


def _s_phase(text: np.ndarray, size: int, l_type: Sorted, room: Room) -> Iterator[tuple[int, Block, bool]]:
    """(character, block, is S-type) of all suffixes, the largest first; a tuple's common prefix is that with the larger neighbour."""
    queue = Queue(room)
    for c in range(size - 1, -1, -1):
        lately: dict[int, int] = {}
        last = -1
        while (block := queue.pop(c)) is not None:
            if last < 0:
                block = _with_first(block, 0)
            yield c, block, True
            _induce(text, block, lambda x: x <= c, lately, queue)
            last = int(block[0][-1])
        if c == 0:
            yield 0, (np.array([len(text) - 1]), np.array([last >= 0], np.uint8)), True
        following = None
        for place, common in l_type.backwards(c):
            if following is None:
                following = 0 if last < 0 else _boundary(text, last, int(place[-1]))
            block = place[::-1], np.concatenate([common[1:], [following]]).astype(np.uint8)[::-1]
            following = int(common[0])
            yield c, block, False
            _induce(text, block, lambda x: x < c, lately, queue)


def _star_places(text: np.ndarray, room: Room) -> np.ndarray:
    """Places of S-type suffixes behind an L-type one, and the end."""
    found, s_after = [np.array([len(text) - 1])], False  # the type of the place after the block, which is settled from the right
    step = room.rows
    for a in range((len(text) - 2) // step * step, -1, -step):
        b = min(a + step, len(text) - 1)
        part = text[a : b + 1].astype(np.int64)
        change = np.sign(np.diff(part))
        if b == len(text) - 1:
            change[-1] = -1  # what is before the end is larger
        places = np.where(change != 0, np.arange(b - a), b - a)
        following = np.minimum.accumulate(places[::-1])[::-1]
        is_s = np.where(following < b - a, change[np.minimum(following, b - a - 1)] > 0, s_after)
        larger_before = np.concatenate([[bool(a and text[a - 1] > text[a])], change[:-1] < 0])
        found.append(np.flatnonzero(is_s & larger_before) + a)
        s_after = bool(is_s[0])
    return np.concatenate(found[::-1])


def _doubled(names: np.ndarray, need: int) -> Block:
    """Suffixes of names in order, and the common prefix of neighbours in names; in memory."""
    ranks, n, h = [names], len(names), 1
    while h < need and int(ranks[-1].max()) + 1 < n:
        r = ranks[-1]
        later = np.zeros(n, dtype=np.int64)
        later[: n - h] = r[h:] + 1
        ranks.append(np.unique(r * (int(r.max()) + 2) + later, return_inverse=True)[1])
        h *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = b + common < n
        inside &= a + common < n
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += (inside & (ranks[k][x] == ranks[k][y])) << k
    return order, np.concatenate([[0], common])


def _gathered(blocks: Iterator[Block], n: int, room: Room) -> Block:
    """Blocks, the largest suffix first, as one sequence from the smallest, with common prefixes with the smaller neighbour."""
    place, common, at = room.array(n, np.int64), room.array(n, np.uint8), n
    for p, c in blocks:
        at -= len(p)
        place[at : at + len(p)] = p[::-1]
        common[at : at + len(p)] = c[::-1]
    common[1:] = common[:-1].copy() if n <= room.rows else _shifted(common, room)
    common[:1] = 0
    return place, common


def _shifted(values: np.ndarray, room: Room) -> np.ndarray:
    out = room.array(len(values) - 1, values.dtype)
    out[:] = values[:-1]
    return out


def _stars(text: np.ndarray, blocks: Iterator[tuple[int, Block, bool]]) -> Iterator[Block]:
    """Only the S* suffixes, with their common prefixes."""
    least = 0
    for c, (place, common), is_s in blocks:
        star = np.flatnonzero((place == len(text) - 1) | (text[np.maximum(place - 1, 0)] > c) & (place > 0)) if is_s else np.zeros(0, np.int64)
        if len(star):
            begin = np.concatenate([[0], star[:-1] + 1])
            low = RangeMin(common).of(begin, star + 1)
            low[0] = min(low[0], least)
            yield place[star], low
            rest = common[star[-1] + 1 :]
            least = int(rest.min(initial=MOST_COMMON))
        else:
            least = min(least, int(common.min(initial=MOST_COMMON)))


def _extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefixes, from what names tell: names differ by type where a run goes on behind the shorter substring."""
    active = np.arange(len(a))
    while len(active):
        x, y = a[active] + common[active], b[active] + common[active]
        inside = (x < len(text)) & (y < len(text)) & (common[active] < MOST_COMMON)
        active, x, y = active[inside], x[inside], y[inside]
        active = active[text[x] == text[y]]
        common[active] += 1
    return common


def suffixes(text: np.ndarray, size: int, need: int, room: Room) -> Iterator[Block]:
    """All suffixes of ``text`` in blocks, the largest first, each with its common prefix with the one before.

    ``text`` has characters below ``size`` and ends in a zero; a zero never follows a zero.
    """
    star = _star_places(text, room)
    n = len(star)
    if n == 1:
        order, common = star, np.zeros(1, np.uint8)
    else:
        seeds = star[np.argsort(text[star], kind="stable")]
        blocks = _s_phase(text, size, _l_phase(text, size, (seeds, np.ones(n, np.uint8)), room), room)
        place, common = _gathered(_stars(text, blocks), n, room)
        index = np.searchsorted(star, place)
        length = np.append(np.diff(star) + 1, 1)[index]
        new = np.ones(n, dtype=bool)
        new[1:] = (length[1:] != length[:-1]) | (common[1:] < length[1:])
        names = room.array(n, np.int64)
        names[index] = np.cumsum(new) - 1
        between = RangeMin(np.asarray(common)[new])
        if new.all():
            order, units = index, np.zeros(n, np.int64)
        elif n <= room.base or need <= 2:
            order, units = _doubled(names, -(-need // 2))
        else:
            order, units = _gathered(suffixes(names, int(new.sum()), -(-need // 2), room), n, room)
            units = units.astype(np.int64)
        a, b = order[:-1], order[1:]
        x, y = np.minimum(a + units[1:], n - 1), np.minimum(b + units[1:], n - 1)
        rest = np.zeros(n - 1, np.int64)
        differ = np.flatnonzero(names[x] != names[y])
        if len(differ):
            p, q = names[x[differ]], names[y[differ]]
            rest[differ] = between.of(np.minimum(p, q) + 1, np.maximum(p, q) + 1)
        order = star[order]
        common = np.concatenate([[0], _extended(text, order[:-1], order[1:], np.minimum(star[x] - star[a] + rest, MOST_COMMON))]).astype(np.uint8)
    for _, block, _ in _s_phase(text, size, _l_phase(text, size, (order, common), room), room):
        yield block
