"""External induced sorting of suffixes with common-prefix values, on disk-backed queues.

Symbols are 1 to 256, separators 0; suffixes end at the next separator. The S* suffixes (an S-type after an L-type) are
ordered first: their substrings get names, the names make a reduced string, and its suffixes are ordered by recursion. From
them a left-to-right pass induces the L-types and a right-to-left pass the S-types.

The priority queues hold tuples (symbol, arrival) -> (place, preceding symbols, run, common prefix). A suffix is induced from
its tuple alone: the preceding symbols travel with it and are read from the text again only when four are used up. Over
the 257 symbols of a text arrivals come in rising order, so the queue is one first-in first-out queue per symbol; over the
names of a reduced string it is a heap of sorted runs. Both spill to temporary files beyond ``memory`` entries.

``common prefix``: how many symbols a suffix shares with the one before it in the order, counted up to ``depth``. Two
suffixes that one symbol is put before share one more than the least value on the way from one to the other, which a
table of range minima of each block gives. Where L-types and S-types of one symbol meet, the shorter run of that symbol
decides.

The recursion ends where all names differ or the reduced string has at most 2 x ``memory`` symbols, which are then ordered by
prefix doubling. No match longer than ``depth`` is asked for: names and doubling look no further. The text, the names and
whatever else grows with it are files, read through memory maps.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np

MEMORY, BLOCK, SIZE, FILLER = 1 << 20, 1 << 16, 257, 511
Block = tuple[np.ndarray, ...]  # place, prev (four preceding symbols, 16 bits each, the nearest highest), run, lcp
_TYPES = (np.int64, np.uint64, np.uint8, np.uint8)


def _disk_array(n: int, kind: type) -> np.ndarray:
    """Zeros in a temporary file that has no name: it goes with the array."""
    file = tempfile.TemporaryFile()
    file.truncate(max(1, n) * np.dtype(kind).itemsize)
    return np.memmap(file, kind, "r+", shape=(max(1, n),))[:n]


class DiskQueue:
    """Blocks of entries, popped from either end. What exceeds the budget shared with other queues goes to a temporary file."""

    def __init__(self, budget: list[int]):
        self.budget, self.blocks, self.file, self.spilled = budget, deque(), None, 0

    def push(self, block: Block) -> None:
        n = len(block[0])
        if self.budget[0] >= n:
            self.budget[0] -= n
            self.blocks.append(block)
            return
        self.file = self.file or tempfile.TemporaryFile()
        self.blocks.append((self.file.seek(0, 2), n))
        for column, kind in zip(block, _TYPES, strict=True):
            self.file.write(column.astype(kind).tobytes())
        self.spilled += n

    def _load(self, block) -> Block:
        if len(block) == len(_TYPES):
            self.budget[0] += len(block[0])
            return block
        self.file.seek(block[0])
        return tuple(np.frombuffer(self.file.read(block[1] * np.dtype(kind).itemsize), kind) for kind in _TYPES)

    def _close(self) -> None:
        if self.file is not None and not self.blocks:
            self.file.close()
            self.file = None

    def pop_first(self) -> Block:
        """Blocks from the front, gathered up to about ``BLOCK`` entries."""
        got, n = [], 0
        while self.blocks and n < BLOCK:
            got.append(self._load(self.blocks.popleft()))
            n += len(got[-1][0])
        self._close()
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def pop_last(self) -> Block:
        out = self._load(self.blocks.pop())
        self._close()
        return out

    def __bool__(self) -> bool:
        return bool(self.blocks)


class DiskHeap:
    """Least-first priority queue of triples of integers: a heap in memory, and sorted runs in temporary files."""

    def __init__(self, memory: int):
        self.memory, self.heap, self.heads, self.runs = max(2, memory), [], [], 0

    @staticmethod
    def _read(file) -> Iterator[tuple[int, ...]]:
        file.seek(0)
        while raw := file.read(24 * 1024):
            yield from map(tuple, np.frombuffer(raw, np.int64).reshape(-1, 3).tolist())

    def push(self, item: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            file = tempfile.TemporaryFile()
            file.write(np.array(sorted(self.heap), np.int64).tobytes())
            self.heap, self.runs = [], self.runs + 1
            run = self._read(file)
            heapq.heappush(self.heads, (next(run), self.runs, run))

    def least(self) -> tuple[int, int, int] | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, int, int]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, number, run = self.heads[0]
            if (following := next(run, None)) is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, number, run))
            return item
        return heapq.heappop(self.heap)


def _name(keys: Iterable[tuple[bytes, int]], n: int, memory: int) -> tuple[np.ndarray, int]:
    """names[i]: the rank, from 1, of the key of i among the different keys; places without a key have 0. By merging runs."""
    names, files, held = _disk_array(n, np.int64), [], []

    def spill() -> None:
        held.sort()
        files.append(tempfile.TemporaryFile())
        for i in range(0, len(held), 1024):
            pickle.dump(held[i : i + 1024], files[-1])
        held.clear()

    def read(file) -> Iterator[tuple[bytes, int]]:
        file.seek(0)
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                return

    for item in keys:
        held.append(item)
        if len(held) >= max(2, memory):
            spill()
    spill()
    count, last = 0, None
    for key, i in heapq.merge(*map(read, files)):
        if key != last:
            count, last = count + 1, key
        names[i] = count
    return names, count


def _doubled(names: np.ndarray, reach: int) -> np.ndarray:
    """Places of names other than 0, ascending by the next ``reach`` names (up to a 0). In memory."""
    names = np.asarray(names)
    n = len(names)
    zeros = np.flatnonzero(names == 0)
    left = np.repeat(np.append(zeros, n), np.diff(np.append(zeros, n), prepend=-1))[:n] - np.arange(n)  # names up to the next 0
    order = np.argsort(names, kind="stable")
    rank, first = np.zeros(n, np.int64), np.ones(n, bool)
    first[1:] = names[order[1:]] != names[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group has the rank of its first place
    at, h = np.arange(len(zeros), n), 1
    while h < reach:
        # Only groups of several places are ordered further.
        last = np.ones(n, bool)
        last[:-1] = first[1:]
        at = at[~(first[at] & last[at])]
        if not len(at):
            break
        place = order[at]
        key = rank[place] << 32 | np.where(left[place] > h, rank[np.minimum(place + h, n - 1)] + 1, 0)
        inner = np.argsort(key)
        order[at], key = place[inner], key[inner]
        first[at[1:]] |= key[1:] != key[:-1]
        rank[order[at]] = np.maximum.accumulate(np.where(first[at], at, 0))
        h *= 2
    return order[len(zeros) :]


def _suffix_order(names: np.ndarray, distinct: int, reach: int, memory: int) -> np.ndarray:
    """Places of names other than 0, ascending by the next ``reach`` names. This is the recursion."""
    n = len(names)
    if n <= 2 * memory:
        return _doubled(names, reach)
    zeros = sum(int((names[i : i + BLOCK] == 0).sum()) for i in range(0, n, BLOCK))
    if distinct == n - zeros:
        out = _disk_array(distinct, np.int64)
        for i in range(0, n, BLOCK):
            part = np.asarray(names[i : i + BLOCK])
            out[part[part > 0] - 1] = i + np.flatnonzero(part)
        return out
    return _induced(names, reach, memory)


def _induced(s: np.ndarray, reach: int, memory: int) -> np.ndarray:
    """The order of the suffixes of a string of names (it ends with 0), induced by way of a disk-backed heap."""
    n, count, rising, after = len(s), 0, True, 0
    s, star = memoryview(s), memoryview(_disk_array(n, np.int64))
    for i in range(n - 1, -1, -1):
        c = s[i]
        was, rising = rising, c == 0 or c < after or (c == after and rising)
        if i < n - 1 and was and ((not rising) or after == 0):
            star[count], count = i + 1, count + 1
        after = c
    if rising and after == 0:
        star[count], count = 0, count + 1
    star = star[:count][::-1]

    def keys() -> Iterator[tuple[bytes, int]]:
        for j in range(count - 1):
            a, e = star[j], star[j + 1]
            if s[a]:
                # A substring that another one continues is the greater: its end is of S-type, the other's place of L-type.
                yield b"".join(x.to_bytes(8, "big") for x in s[a : min(e + 1, a + reach)]) + b"\xff" * 8, j

    names, distinct = _name(keys(), count, memory)
    order, heap, arrival = _suffix_order(names, distinct, reach, memory), DiskHeap(memory), 0
    lows, n_low = memoryview(_disk_array(n, np.int64)), 0

    def stars() -> Iterator[int]:
        yield from (x for x in star if s[x] == 0)
        for j in range(0, len(order), BLOCK):
            yield from (star[i] for i in order[j : j + BLOCK].tolist())

    feed = stars()
    seed = next(feed, None)
    while seed is not None or heap.least() is not None:
        top = heap.least()
        if top is not None and (seed is None or top[0] <= s[seed]):
            c, _, i = heap.pop()
            lows[n_low], n_low = i, n_low + 1
            take = i > 0 and s[i - 1] >= c
        else:
            i, c, seed = seed, s[seed], next(feed, None)
            take = i > 0 and s[i - 1] > c
        if take:
            heap.push((s[i - 1], arrival, i - 1))
            arrival += 1
    placed = _disk_array(n, np.int64)
    out, k, heap, low = memoryview(placed), n, DiskHeap(memory), n_low - 1
    while low >= 0 or heap.least() is not None:
        top = heap.least()
        if top is not None and (low < 0 or -top[0] >= s[lows[low]]):
            c, _, i = heap.pop()
            c, take = -c, i > 0 and 0 < s[i - 1] <= -c
        else:
            i, low = lows[low], low - 1
            c = s[i]
            take = i > 0 and 0 < s[i - 1] < c
        k -= 1
        out[k] = i
        if take:
            heap.push((-s[i - 1], arrival, i - 1))
            arrival += 1
    return placed[k:]


def _stars(text: np.ndarray) -> np.ndarray:
    """Places of S* suffixes and of separators, ascending. Read backwards a block at a time."""
    n, out, rising, after = len(text), [], True, 0
    for lo in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        part = np.asarray(text[lo : min(n, lo + BLOCK)]).astype(np.int32)
        following = np.r_[part[1:], after]
        differ = part != following
        differ[-1] = True
        ends = np.flatnonzero(differ)
        kinds = part[ends] < following[ends]
        if part[-1] == following[-1]:
            kinds[-1] = rising
        kind = np.repeat(kinds, np.diff(ends, prepend=-1)) | (part == 0)
        before = np.r_[0 if lo == 0 else int(text[lo - 1]), part[:-1]]
        out.append(lo + np.flatnonzero((kind & (before > part)) | (part == 0)))
        rising, after = bool(kind[0]), int(part[0])
    return np.concatenate(out[::-1]) if out else np.zeros(0, np.int64)


def _packed(text: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Seven symbols from ``place`` on, the first one highest; what is beyond ``size`` is filled."""
    out = np.zeros(len(place), np.uint64)
    for k in range(7):
        symbol = np.where(k < size, text[np.minimum(place + k, len(text) - 1)], FILLER).astype(np.uint64)
        out |= symbol << np.uint64(9 * (6 - k))
    return out


def _names_in_memory(text: np.ndarray, stars: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """As ``_name`` of the S* substrings (0 for separators), by words of seven symbols."""
    size = np.diff(stars, append=stars[-1:]) + 1
    real = np.flatnonzero(text[stars] != 0)
    place, size = stars[real], size[real]
    word = lambda of, k: _packed(text, place[of] + 7 * k, size[of] - 7 * k)
    rank = np.unique(word(np.arange(len(real)), 0), return_inverse=True)[1].astype(np.int64)
    for k in range(1, -(-depth // 7)):
        longer = size > 7 * k
        if not longer.any():
            break
        touched = np.zeros(int(rank.max()) + 1, bool)
        touched[rank[longer]] = True
        of = np.flatnonzero(touched[rank])
        w = word(of, k)
        order = np.lexsort((w, rank[of]))
        r, w = rank[of][order], w[order]
        new = np.r_[False, (r[1:] == r[:-1]) & (w[1:] != w[:-1])]
        more = np.zeros(len(touched) + 1, np.int64)
        np.add.at(more, r[new] + 1, 1)
        shift = np.cumsum(more)
        lead = np.r_[True, r[1:] != r[:-1]]
        seen = np.cumsum(new)
        within = seen - np.maximum.accumulate(np.where(lead, seen, 0))
        rank = rank + shift[rank]
        rank[of[order]] += within
    names = np.zeros(len(stars), np.int64)
    names[real] = rank + 1
    return names, int(rank.max(initial=-1)) + 1


def _fours(text: np.ndarray) -> np.ndarray:
    """Of a text padded by ``_padded``: the four symbols before each place as one number, the nearest highest. Four places
    further on it is the symbols from the place on, the first one lowest."""
    return np.ndarray((len(text) - 3,), np.uint64, text, strides=(2,))


def _shared(fours: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to ``depth``; they end at a separator."""
    out, active, low, high = np.zeros(len(a), np.int64), np.arange(len(a)), np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)
    for k in range(0, depth, 4):
        x = fours[a[active] + k + 4]
        ends = x ^ fours[b[active] + k + 4]  # a place counts as different where either symbol is 0
        ends |= (x - low) & ~x & high
        same = ends == 0
        rest = ends[~same]
        if len(rest):
            bit = np.frexp((rest & (~rest + np.uint64(1))).astype(np.float64))[1] - 1  # the lowest bit set
            out[active[~same]] = k + (bit >> 4)
        active = active[same]
        if not len(active):
            break
    out[active] = depth
    return np.minimum(out, depth).astype(np.uint8)


class _Induction:
    """The queues of one pass, and for each symbol the least common prefix since its last arrival."""

    def __init__(self, fours: np.ndarray, depth: int, budget: list[int]):
        self.fours, self.depth = fours, depth
        self.queues, self.since = [DiskQueue(budget) for _ in range(SIZE)], np.full(SIZE, 255, np.uint8)

    def feed(self, c: int, block: Block, takes: Callable[[np.ndarray], np.ndarray]) -> None:
        """``block`` of suffixes with first symbol c in the order of the pass; each induces the one before it if that symbol ``takes``."""
        place, prev, run, lcp = block
        symbol = prev >> np.uint64(48)
        if (used := np.flatnonzero(symbol == FILLER)).size:
            prev = prev.copy()
            prev[used] = self.fours[place[used]]
            symbol = prev >> np.uint64(48)
        symbol = symbol.astype(np.int64)
        at = np.flatnonzero(takes(symbol) & (symbol > 0))
        n, low = len(lcp), lcp.min()
        if not len(at):
            self.since = np.minimum(self.since, low)
            return
        at = at[np.argsort(symbol[at].astype(np.uint16), kind="stable")]
        target = symbol[at]
        lead = np.ones(len(at), bool)
        lead[1:] = target[1:] != target[:-1]
        table = np.empty((n.bit_length(), n), np.uint8)  # row k: the minima of 2^k values
        table[0] = lcp
        for k in range(1, len(table)):
            m, half = n - (1 << k) + 1, 1 << (k - 1)
            np.minimum(table[k - 1, :m], table[k - 1, half : half + m], out=table[k, :m])

        def least(a: np.ndarray, e: np.ndarray) -> np.ndarray:
            level = np.frexp((e - a).astype(np.float64))[1] - 1  # of a range of e - a values
            return np.minimum(table[level, a], table[level, e - (1 << level)])

        begin = np.zeros(len(at), np.int64)
        begin[1:] = at[:-1] + 1
        begin[lead] = 0
        floor = least(begin, at + 1)
        floor[lead] = np.minimum(floor[lead], self.since[target[lead]])
        following = np.minimum(floor.astype(np.int16) + 1, self.depth).astype(np.uint8)
        runs = np.where(target == c, np.minimum(run[at].astype(np.int16) + 1, self.depth), 1).astype(np.uint8)
        rest = (prev[at] << np.uint64(16)) | np.uint64(FILLER)
        cuts = [*np.flatnonzero(lead).tolist(), len(at)]
        self.since = np.minimum(self.since, low)
        for a, e in zip(cuts, cuts[1:], strict=False):
            self.queues[int(target[a])].push((place[at[a:e]] - 1, rest[a:e], runs[a:e], following[a:e]))
            last = int(at[e - 1]) + 1
            self.since[target[a]] = lcp[last:].min() if last < n else 255


def _meets(block: Block, run: int | None) -> Block:
    """The first of a block shares with the one before it the shorter run of their symbol, nothing if there is none."""
    block[3][:1] = min(run, int(block[2][0])) if run is not None else 0
    return block


def _padded(text: np.ndarray, more: int) -> np.ndarray:
    """A copy in a file, with four separators before its beginning and ``more`` behind its end."""
    out = _disk_array(len(text) + 4 + more, np.uint16)
    for i in range(0, len(text), 1 << 20):
        out[4 + i : 4 + min(len(text), i + (1 << 20))] = text[i : i + (1 << 20)]
    return out


def sorted_suffixes(text: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefix with the one before), in blocks, from the last suffix to the first; separators left out."""
    if not len(text):
        return
    stars, budget, fours = _stars(text), [memory], _fours(_padded(text, depth + 4))
    if len(stars) <= 2 * memory:
        names, distinct = _names_in_memory(text, stars, depth)
    else:
        ends = [*stars[1:].tolist(), int(stars[-1])]
        pack = lambda a, e: (np.r_[text[a : min(e + 1, a + depth)], FILLER].astype(">u2").tobytes())
        names, distinct = _name(((pack(a, e), j) for j, (a, e) in enumerate(zip(map(int, stars), ends, strict=True)) if text[a]), len(stars), memory)
    order = _suffix_order(names, distinct, depth // 2 + 1, memory)
    left, right = _Induction(fours, depth, budget), _Induction(fours, depth, budget)
    seeds, lows = [DiskQueue(budget) for _ in range(SIZE)], [DiskQueue(budget) for _ in range(SIZE)]
    zeros = stars[text[stars] == 0]
    for i in range(0, len(zeros), BLOCK):
        part = zeros[i : i + BLOCK]
        seeds[0].push((part, fours[part], np.ones(len(part), np.uint8), np.zeros(len(part), np.uint8)))
    last = np.zeros(0, np.int64)
    for i in range(0, len(order), BLOCK):
        part = stars[order[i : i + BLOCK]]
        behind = np.r_[last if len(last) else part[:1], part[:-1]]
        lcp, first = _shared(fours, behind, part, depth), np.asarray(text[part]).astype(np.int64)
        run, active = np.ones(len(part), np.uint8), np.arange(len(part))
        for k in range(1, depth):
            active = active[text[np.minimum(part[active] + k, len(text) - 1)] == first[active]]
            if not len(active):
                break
            run[active] += 1
        prev, cuts = fours[part], np.flatnonzero(np.r_[True, first[1:] != first[:-1], True])
        for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            seeds[int(first[a])].push((part[a:e], prev[a:e], run[a:e], lcp[a:e]))
        last = part[-1:]
    for c in range(SIZE):
        run = None
        while left.queues[c]:
            block = left.queues[c].pop_first()
            if run is None:
                block = _meets(block, None)
            run = int(block[2][-1])
            lows[c].push(block)
            left.feed(c, block, lambda b, c=c: b >= c)
        begun = False
        while seeds[c]:
            block = seeds[c].pop_first()
            if not begun:
                block, begun = _meets(block, run), True
            left.feed(c, block, lambda b, c=c: b > c)
    for c in range(SIZE - 1, 0, -1):
        run = None
        while right.queues[c]:
            block = right.queues[c].pop_first()
            if run is None:
                block = _meets(block, None)
            run = int(block[2][-1])
            yield block[0], block[3]
            right.feed(c, block, lambda b, c=c: b <= c)
        carried = None  # of the reversed order: what the next lower suffix shares with the one above it
        while lows[c]:
            place, prev, size, lcp = (x[::-1] for x in lows[c].pop_last())
            shifted = np.r_[np.uint8(0 if carried is None else carried), lcp[:-1]].astype(np.uint8)
            block = (place, prev, size, shifted)
            if carried is None:
                block = _meets(block, run)
            carried = int(lcp[-1])
            yield block[0], block[3]
            right.feed(c, block, lambda b, c=c: b < c)


def repeats(text: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, begins): groups of two or more places whose first ``depth`` symbols are equal and hold no separator, end to
    end, and where each group begins. Told by the common prefixes alone. A group larger than a block is held whole."""
    tail = np.zeros(0, np.int64)
    for place, lcp in sorted_suffixes(text, depth, memory):
        place, joined = np.r_[tail, place], np.r_[np.ones(max(0, len(tail) - 1), bool), lcp >= depth]
        starts = np.r_[True, ~joined] if len(tail) else np.r_[True, ~joined[1:]]
        cuts = np.flatnonzero(starts)
        sizes = np.diff(cuts)
        several = sizes > 1
        if several.any():
            yield place[: cuts[-1]][np.repeat(several, sizes)], np.r_[0, np.cumsum(sizes[several])][:-1]
        tail = place[cuts[-1] :]
    if len(tail) > 1:
        yield tail, np.zeros(1, np.int64)
