"""Suffix arrays with common-prefix values by external induced sorting.

Suffixes are induced bucket by bucket: sorted LMS suffixes induce the L-type ones in ascending order, these the S-type
ones in descending order. A priority queue holds the induced suffixes by their first character; as a suffix is always put in
behind those that are there and never before the bucket being read, a queue is one run for each character. A tuple in
it is (position, common prefix with the tuple before it). Runs beyond a memory bound go to an unnamed scratch file of the
task and are read back when their bucket's turn comes. The common prefix of two induced suffixes is one more than the
least common prefix between those that induced them, so prefixes are carried along and never compared anew.

LMS substrings get their order from a first induction; where two are equal, the string of their names is sorted by the
same procedure, recursively. Names of more than SMALL symbols, for which a pass per symbol would not pay, are
ranked by doubling instead.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Alphabets up to this size are sorted by induction.
SMALL = 1024
#: Common prefixes are not counted beyond this.
MOST = 255
#: Bytes of queued tuples held in memory.
QUEUE_BYTES = 64 << 20


class Queue:
    """Runs of (position, common prefix) for each character, on disk beyond a memory bound."""

    def __init__(self, memory: int = QUEUE_BYTES):
        self.runs: dict[int, list] = {}
        self.held, self.memory, self.file = 0, memory, None

    def put(self, char: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.runs.setdefault(char, []).append((positions, prefixes))
        self.held += positions.nbytes + prefixes.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for runs in self.runs.values():
            for k, run in enumerate(runs):
                if not isinstance(run[0], int):
                    at = self.file.seek(0, 2)
                    self.file.write(run[0].tobytes())
                    self.file.write(run[1].tobytes())
                    runs[k] = (at, len(run[0]))
        self.held = 0

    def take(self, char: int) -> tuple[np.ndarray, np.ndarray]:
        """All of a character's tuples, in the order they came."""
        out = []
        for run in self.runs.pop(char, ()):
            if isinstance(run[0], int):
                self.file.seek(run[0])
                n = run[1]
                out.append((np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)))
            else:
                self.held -= run[0].nbytes + run[1].nbytes
                out.append(run)
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        return np.concatenate([p for p, _ in out]), np.concatenate([c for _, c in out])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _least_between(prefixes: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """For consecutive sources a, b the least of prefixes[a+1..b], either way round; the first gets 0."""
    out = np.zeros(len(sources), np.uint8)
    if len(sources) < 2:
        return out
    a, b = np.minimum(sources[:-1], sources[1:]) + 1, np.maximum(sources[:-1], sources[1:]) + 1
    width = b - a
    table, level = prefixes, 0
    levels = np.where(width > 0, np.frexp(np.maximum(width, 1).astype(np.float64))[1] - 1, 0)
    least = np.full(len(a), MOST, np.uint8)
    while True:
        own = levels == level
        if own.any():
            least[own] = np.minimum(table[a[own]], table[b[own] - (1 << level)])
        level += 1
        if level > levels.max():
            break
        half = 1 << (level - 1)
        table = np.minimum(table[:-half], table[half:]) if len(table) > half else table[:0]
    out[1:] = least
    return out


def _more(prefixes: np.ndarray, k: int = 1) -> np.ndarray:
    return np.minimum(prefixes.astype(np.int64) + k, MOST).astype(np.uint8)


def _order(symbols: np.ndarray) -> np.ndarray:
    """Stable order; small symbols are sorted by radix."""
    return np.argsort(symbols.astype(np.uint16) if len(symbols) and symbols.max() < 1 << 16 else symbols, kind="stable")


def _spread(queue: Queue, text: np.ndarray, sources: np.ndarray, prefixes: np.ndarray, wanted: np.ndarray, carry: bool) -> None:
    """Puts the wanted sources' left neighbours into their characters' queues, in the order of the sources."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return
    left = sources[at] - 1
    chars = text[left]
    order = _order(chars)
    at, left, chars = at[order], left[order], chars[order]
    common = _more(_least_between(prefixes, at)) if carry else np.zeros(len(at), np.uint8)
    firsts = np.concatenate(([0], np.flatnonzero(np.diff(chars)) + 1, [len(chars)]))
    for a, b in zip(firsts[:-1], firsts[1:]):
        own = common[a:b].copy()
        own[0] = 1  # what stands before it comes from another bucket
        queue.put(int(chars[a]), left[a:b].astype(np.int64), own)


def _pass(text, smaller, runs, seeds, seed_prefixes, seed_bounds, chars, descending: bool, memory: int, carry: bool):
    """One induction over the buckets. seeds of a bucket lie behind its induced suffixes in reading order.

    Ascending: induces L-type suffixes (smaller == False) from LMS seeds. Descending: S-type from the L-type ones.
    Returns the induced suffixes by character, in ascending order.
    """
    queue, out = Queue(memory), {}
    own_type = descending
    for c in chars[::-1] if descending else chars:
        held, prefixes = queue.take(int(c))
        parts, common, turn = [], [], 0
        while len(held):
            parts.append(held)
            common.append(prefixes)
            turn += 1
            ok = held > 0
            ok[ok] = (text[held[ok] - 1] == c) & (smaller[held[ok] - 1] == own_type)
            at = np.flatnonzero(ok)
            held, prefixes = held[at] - 1, _more(_least_between(prefixes, at)) if carry else prefixes[at]
            if len(prefixes):
                prefixes[0] = min(turn, MOST)
        induced = np.concatenate(parts) if parts else np.empty(0, np.int64)
        joined = np.concatenate(common) if common else np.empty(0, np.uint8)
        a, b = seed_bounds.get(int(c), (0, 0))
        own, own_prefixes = seeds[a:b], seed_prefixes[a:b].copy()
        if descending:
            # prefixes to the one before become prefixes to the one after, read from the end
            own = own[::-1]
            own_prefixes = np.concatenate(([0], own_prefixes[1:][::-1])).astype(np.uint8) if len(own) else own_prefixes
        if len(own):
            own_prefixes[0] = min(runs[induced[-1]], runs[own[0]], MOST) if len(induced) else 0
        whole, all_prefixes = np.concatenate((induced, own)), np.concatenate((joined, own_prefixes))
        out[int(c)] = (induced, joined)
        ok = whole > 0
        left = whole[ok] - 1
        ok[ok] = (smaller[left] == own_type) & (text[left] != c)
        _spread(queue, text, whole, all_prefixes, ok, carry)
    queue.close()
    return out


def _induce(text, smaller, runs, lms, lms_prefixes, memory, carry=True):
    """All suffixes in order, with common prefixes, from LMS suffixes in order."""
    chars = np.unique(text)
    firsts = text[lms]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(firsts)) + 1, [len(lms)])) if len(lms) else np.zeros(1, int)
    bounds = {int(firsts[a]): (a, b) for a, b in zip(cuts[:-1], cuts[1:])}
    large = _pass(text, smaller, runs, lms, lms_prefixes, bounds, chars, False, memory, carry)
    sizes = np.cumsum([0] + [len(large[int(c)][0]) for c in chars])
    flat = np.concatenate([large[int(c)][0] for c in chars])
    prefixes = np.concatenate([large[int(c)][1] for c in chars])
    bounds = {int(c): (a, b) for c, a, b in zip(chars, sizes[:-1], sizes[1:])}
    small = _pass(text, smaller, runs, flat, prefixes, bounds, chars, True, memory, carry)
    order, common = [], []
    for c in chars:
        a, b = bounds[int(c)]
        down, down_prefixes = small[int(c)]
        if int(c) == int(text[-1]):
            # the sentinel ends the text: nothing induces it
            down, down_prefixes = np.array([len(text) - 1]), np.zeros(1, np.uint8)
        up = down[::-1]
        up_prefixes = np.concatenate(([0], down_prefixes[1:][::-1])).astype(np.uint8) if len(up) else down_prefixes
        if len(up) and b > a:
            up_prefixes[0] = min(runs[flat[b - 1]], runs[up[0]], MOST)
        own = prefixes[a:b].copy()
        if len(own):
            own[0] = 0
        order += [flat[a:b], up]
        common += [own, up_prefixes]
    return np.concatenate(order), np.concatenate(common)


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a suffix is smaller than the next one; how often its first character is repeated from there."""
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # last place of each run
    last = np.repeat(change, np.diff(np.append(-1, change)))
    after = np.append(text, 0)[last + 1]
    smaller = text < after
    smaller[-1] = True
    return smaller, last - np.arange(n) + 1


def _doubled(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Suffix array by ranks of doubled length, from the places in the order of their symbols; only what is still tied is sorted again."""
    n, step = len(text), 1
    order, rank = order.copy(), np.empty(n, np.int64)
    slots, keys = np.arange(n), text[order]
    while True:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        firsts = np.flatnonzero(new)
        rank[order[slots]] = np.repeat(slots[firsts], np.diff(np.append(firsts, len(slots))))
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return order
        tied = order[slots]
        beyond = tied + step
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        keys = rank[tied] * (n + 1) + second
        own = np.argsort(keys, kind="stable")
        order[slots], keys = tied[own], keys[own]
        step *= 2


def _common(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of neighbours in a sorted list of LMS suffixes, up to `most`."""
    out = np.zeros(len(order), np.int64)
    if text.max() < 1 << 8:
        return _common_bytes(text.astype(np.uint8), order, most)
    padded = np.append(text, np.full(4, -1)).astype(np.int64)
    if text.max() < 1 << 15:  # four symbols at a time
        packed = padded[:-3].copy()
        for k in (1, 2, 3):
            packed = packed << 16 | (padded[k : len(padded) - 3 + k] & 0xFFFF)
        steps = ((4, packed), (1, padded))
    else:
        steps = ((1, padded),)
    at, a, b = np.arange(1, len(order)), order[:-1].copy(), order[1:].copy()
    for width, symbols in steps:
        rest = []
        while len(at):
            ok = (np.maximum(a, b) + width <= len(text)) & (out[at] < most)
            ok[ok] = symbols[a[ok]] == symbols[b[ok]]
            rest.append((at[~ok], a[~ok], b[~ok]))
            at, a, b = at[ok], a[ok] + width, b[ok] + width
            out[at] += width
        at, a, b = [np.concatenate(x) for x in zip(*rest)] if rest else (at, a, b)
        if width == 4:
            ok = out[at] < most
            at, a, b = at[ok], a[ok], b[ok]
    return np.minimum(out, most).astype(np.uint8)


def _common_bytes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The same of symbols of a byte, eight at a time: the first place where two words of eight differ tells the rest."""
    n = len(text)
    packed = np.zeros(n, np.uint64)
    for k in range(min(8, n)):
        packed[: n - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(len(order), np.int64)
    at, a, b = np.arange(1, len(order)), order[:-1], order[1:]
    while len(at):
        other = packed[a] ^ packed[b]
        low = other & (~other + np.uint64(1))
        same = np.where(other > 0, (np.frexp(low.astype(np.float64))[1] - 1) >> 3, 8)
        # behind the text's end stand zeros, which are no symbols
        same = np.minimum(same, n - np.maximum(a, b))
        out[at] += same
        on = (same == 8) & (out[at] < most)
        at, a, b = at[on], a[on] + 8, b[on] + 8
        inside = np.maximum(a, b) < n
        if not inside.all():
            at, a, b = at[inside], a[inside], b[inside]
    return np.minimum(out, most).astype(np.uint8)


def suffix_array(text: np.ndarray, most: int = MOST, memory: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a text whose last symbol is its only least one, and common prefixes up to `most`."""
    if len(text) < 3:
        return np.argsort(text, kind="stable"), np.zeros(len(text), np.uint8)
    text = text.astype(np.int32)
    smaller, runs = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # First induction: LMS suffixes by first character only; it sorts the LMS substrings.
    rough = lms[_order(text[lms])]
    order, _ = _induce(text, smaller, runs, rough, np.zeros(len(rough), np.uint8), memory, carry=False)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    sorted_lms = order[is_lms[order]]
    ends = np.append(lms[1:], len(text) - 1)
    length = np.zeros(len(text), np.int64)
    length[lms] = ends - lms + 1
    # neighbours with equal substrings get one name
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = (length[a] == length[b]) & (b != len(text) - 1) & (a != len(text) - 1)
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        bad = text[a[at] + k] != text[b[at] + k]
        same[at[bad]] = False
        at = at[~bad]
        k += 1
        at = at[length[a[at]] > k]
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 < len(lms):
        named = np.zeros(len(text), np.int64)
        named[sorted_lms] = names
        reduced = named[lms]
        if names[-1] < SMALL:
            order = suffix_array(reduced, 1, memory)[0]
        else:
            place = np.empty(len(text), np.int64)
            place[lms] = np.arange(len(lms))
            order = _doubled(reduced, place[sorted_lms])
        sorted_lms = lms[order]
    return _induce(text, smaller, runs, sorted_lms, _common(text, sorted_lms, most), memory)
