"""Matching blocks of two sequences: the longest common run first, then what is left and right of it.

In a block with few pairs of equal elements all runs are found at once, on the
diagonals of these pairs.  The block takes the longest of its runs, the earliest of
equals, grows it by equal elements on both sides, and hands its other runs, cut where
they reach over, to the blocks beside it; so no run is looked for twice.

In a block with more pairs no pair is listed.  The length of the longest run is found
by bisection, as a run of some length implies all shorter ones: whether there is one
is asked of rolling hashes of that length.  The run is then the first place whose hash
the other side has.

In a sequence of 200 elements or more those that make up more than a hundredth of it
start no run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: From this length on frequent elements start no run; more than a hundredth and one are frequent.
LONG, SHARE = 200, 100


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Pairs of equal elements up to which a block's runs are listed.
PAIRS = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _run_lengths(ok: np.ndarray) -> np.ndarray:
    """For each place how many places from it on are in a row."""
    n = len(ok)
    bad = np.append(np.flatnonzero(~ok), n)
    return bad[np.searchsorted(bad, np.arange(n))] - np.arange(n)


class Pair:
    """Two sequences as numbers, with what all blocks need of them."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        values, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        self.a, self.b, self.n_values = at[: len(a)], at[len(a) :], len(values)
        often = np.bincount(self.b, minlength=len(values)) > len(b) // SHARE + 1 if len(b) >= LONG else np.zeros(len(values), bool)
        self.rare = ~often
        self.sides: list[tuple] | None = None

    def pairs(self, a0: int, a1: int, b0: int, b1: int) -> int:
        count = lambda x: np.bincount(x, minlength=self.n_values)
        return int((count(self.a[a0:a1]) * count(self.b[b0:b1]))[self.rare].sum())

    def runs(self, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int, int]]:
        """(length, -first in a, -first in b) of a block's maximal runs; the largest is the one to take."""
        a, b = self.a[a0:a1], self.b[b0:b1]
        order = np.argsort(b, kind="stable")
        in_order = b[order]
        low = np.searchsorted(in_order, a, "left")
        n = (np.searchsorted(in_order, a, "right") - low) * self.rare[a]
        total = int(n.sum())
        if not total:
            return []
        i = np.repeat(np.arange(len(a)), n)
        j = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)]
        key = (j - i + len(a)) * (len(a) + 1) + i  # by diagonal, then along it
        key.sort()
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1] + 1)))
        diagonal, first = np.divmod(key[at], len(a) + 1)
        length = np.diff(np.append(at, total))
        return list(zip(length.tolist(), (-first - a0).tolist(), (len(a) - first - diagonal - b0).tolist(), strict=True))

    def _hashes(self, side: int, first: int, end: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``n`` rare elements in a part of a side, and where they begin."""
        if self.sides is None:
            value = np.random.default_rng(7).integers(0, 1 << 63, self.n_values, dtype=np.uint64)
            self.sides = []
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(len(self.a), len(self.b)), _ODD))), dtype=np.uint64)
            for x in (self.a, self.b):
                sums = np.concatenate(([np.uint64(0)], np.cumsum(value[x] * power[: len(x)], dtype=np.uint64)))
                self.sides.append((sums, power[::-1], _run_lengths(self.rare[x])))
        sums, lift, good = self.sides[side]
        at = first + np.flatnonzero(good[first : max(first, end - n + 1)] >= n)
        return (sums[at + n] - sums[at]) * lift[at], at  # lifted to one power, so equal runs have equal hashes

    def longest(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """The run to take of a block, as ``runs`` has it, without listing any."""
        found, low, high = (0, -a0, -b0), 1, min(a1 - a0, b1 - b0)
        while low <= high:
            n = (low + high) // 2 if found[0] else min(high, 2 * low - 1)
            (x, i), (y, j) = self._hashes(0, a0, a1, n), self._hashes(1, b0, b1, n)
            hit = np.flatnonzero(np.isin(x, y))
            if len(hit):
                k = hit[0]
                found, low = (n, -int(i[k]), -int(j[np.flatnonzero(y == x[k])[0]])), n + 1
            else:
                high = n - 1
        return found


def blocks(a: Sequence, b: Sequence, pair: Pair) -> list[tuple[int, int, int]]:
    """(first in a, first in b, length) of the matching blocks, in order, none next to another."""
    out = []
    todo: list[tuple] = [(0, len(a), 0, len(b), None)]
    while todo:
        a0, a1, b0, b1, here = todo.pop()
        if here is None and pair.pairs(a0, a1, b0, b1) <= PAIRS:
            here = pair.runs(a0, a1, b0, b1)
        n, i, j = pair.longest(a0, a1, b0, b1) if here is None else max(here) if here else (0, -a0, -b0)
        i, j = -i, -j
        ei, ej = i + n, j + n
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while ei < a1 and ej < b1 and a[ei] == b[ej]:
            ei, ej = ei + 1, ej + 1
        if ei == i:
            continue
        out.append((i, j, ei - i))
        if i > a0 and j > b0:
            todo.append((a0, i, b0, j, here and [(k, x, y) for n, x, y in here if (k := min(n, i + x, j + y)) > 0]))
        if ei < a1 and ej < b1:
            todo.append((ei, a1, ej, b1, here and [(n - k, x - k, y - k) for n, x, y in here if (k := max(0, ei + x, ej + y)) < n]))
    whole: list[tuple[int, int, int]] = []
    for i, j, n in sorted(out):
        if whole and whole[-1][0] + whole[-1][2] == i and whole[-1][1] + whole[-1][2] == j:
            i, j, n = *whole[-1][:2], whole.pop()[2] + n
        whole.append((i, j, n))
    return whole


def matching(a: str, b: str) -> list[tuple[int, int, int]]:
    """The matching blocks of two texts, by characters.  Where one begins with the other, each
    run they share also stands at one place in both, so the earliest ones make up the whole."""
    if a.startswith(b) or b.startswith(a):
        return [(0, 0, min(len(a), len(b)))] if a and b else []
    return blocks(a, b, Pair(codes(a), codes(b)))


#: Pairs of elements and characters that the texts compared at once may have, and characters of one of them.
TOGETHER, SHORT = 4_000_000, 1 << 20
_LOW = np.int64((1 << 21) - 1)


def matching_many(olds: Sequence[str], news: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of pairs of texts: the number of the first, and which pair, first in a, first in b
    and length of the matching blocks of all, in order (those next to another aren't joined)."""
    begun, held = 0, 0
    for k, (a, b) in enumerate(zip(olds, news, strict=True)):
        size = min(len(a) * len(b), PAIRS) + len(a) + len(b)
        if k > begun and held + size > TOGETHER:
            yield begun, _together(olds[begun:k], news[begun:k])
            begun, held = k, 0
        held += size
    if begun < len(olds):
        yield begun, _together(olds[begun:], news[begun:])


def _together(olds: Sequence[str], news: Sequence[str]) -> np.ndarray:
    """What ``matching`` does, a step of all texts' blocks at a time; texts with many pairs
    of equal elements, for which no pairs are listed, and very long ones go there."""
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (olds, news))
    sa, sb = (np.cumsum(n) - n for n in (la, lb))
    a, b = codes("".join(olds)).astype(np.int64), codes("".join(news)).astype(np.int64)
    of_a, of_b = (np.repeat(np.arange(len(n)), n) for n in (la, lb))
    order = np.argsort(of_b << 21 | b, kind="stable")
    in_order = (of_b << 21 | b)[order]
    low = np.searchsorted(in_order, of_a << 21 | a, "left")
    n = np.searchsorted(in_order, of_a << 21 | a, "right") - low
    n[(lb[of_a] >= LONG) & (n > lb[of_a] // SHARE + 1)] = 0  # frequent elements start no run
    total = np.bincount(of_a, n, len(la))
    alone = (total > PAIRS) | (np.maximum(la, lb) >= SHORT)
    n[alone[of_a]] = 0
    whole = [np.array([(k, *x) for x in matching(olds[k], news[k])], np.int64).reshape(-1, 4) for k in np.flatnonzero(alone)]

    # maximal runs, by text
    many = int(n.sum())
    i = np.repeat(np.arange(len(a)), n)
    text = of_a[i]
    j = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(many)] - sb[text]
    i -= sa[text]
    wide = int(la.max(initial=0)) + 1
    key = ((np.cumsum(la + lb) - lb)[text] + text + j - i) * wide + i  # by text and diagonal, then along it
    by = np.argsort(key)
    key, i, j, text = key[by], i[by], j[by], text[by]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1] + 1))) if many else np.zeros(0, np.int64)
    at, i, j, n = text[first], i[first], j[first], np.diff(np.append(first, many))

    # blocks: their texts and ends; ``at`` is the block of each run, in order
    own = np.flatnonzero(~alone & (la > 0) & (lb > 0))
    place = np.full(len(la), -1)
    place[own] = np.arange(len(own))
    at = place[at]
    a0, a1, b0, b1 = np.zeros_like(own), la[own], np.zeros_like(own), lb[own]
    while len(own):
        x, y, size = a0.copy(), b0.copy(), np.zeros_like(a0)
        if len(at):
            head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            best = np.maximum.reduceat(n << 42 | (_LOW - i) << 21 | _LOW - j, head)
            to = at[head]
            size[to], x[to], y[to] = best >> 42, _LOW - (best >> 21 & _LOW), _LOW - (best & _LOW)
        ex, ey, pa, pb = x + size, y + size, sa[own], sb[own]
        go = np.flatnonzero((x > a0) & (y > b0))
        while len(go := go[a[pa[go] + x[go] - 1] == b[pb[go] + y[go] - 1]]):
            x[go] -= 1
            y[go] -= 1
            go = go[(x[go] > a0[go]) & (y[go] > b0[go])]
        go = np.flatnonzero((ex < a1) & (ey < b1))
        while len(go := go[a[pa[go] + ex[go]] == b[pb[go] + ey[go]]]):
            ex[go] += 1
            ey[go] += 1
            go = go[(ex[go] < a1[go]) & (ey[go] < b1[go])]
        found = ex > x
        whole.append(np.stack((own, x, y, ex - x), axis=1)[found])
        left, right = np.flatnonzero(found & (x > a0) & (y > b0)), np.flatnonzero(found & (ex < a1) & (ey < b1))
        # the runs of both sides of each block, cut where they reach over
        k = np.minimum(n, np.minimum(x[at] - i, y[at] - j))
        cut = np.maximum(0, np.maximum(ex[at] - i, ey[at] - j))
        before, after = np.flatnonzero(k > 0), np.flatnonzero(cut < n)
        place = np.full((2, len(own)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), len(left) + np.arange(len(right))
        at, i, j, n = (np.concatenate(z) for z in ((place[0, at[before]], place[1, at[after]]), (i[before], i[after] + cut[after]), (j[before], j[after] + cut[after]), (k[before], (n - cut)[after])))
        a0, a1, b0, b1 = np.concatenate((a0[left], ex[right])), np.concatenate((x[left], a1[right])), np.concatenate((b0[left], ey[right])), np.concatenate((y[left], b1[right]))
        own = np.concatenate((own[left], own[right]))
    every = np.concatenate([*whole, np.zeros((0, 4), np.int64)])
    return every[np.lexsort((every[:, 1], every[:, 0]))]


def operations(a: Sequence, b: Sequence, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """equal, replace, delete and insert (a from, to, b from, to) that make b of a."""
    out, i, j = [], 0, 0
    for x, y, n in [*found, (len(a), len(b), 0)]:
        if x > i or y > j:
            out.append(("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out


def similarity(a: str, b: str) -> float:
    """Twice the characters in matching blocks by all characters."""
    return 2 * sum(n for *_, n in matching(a, b)) / (len(a) + len(b)) if a or b else 1.0


def most_similar(text: str, among: Sequence[str], least: float) -> tuple[int, float] | None:
    """The first of the texts that are most similar to one, if that is ``least`` or more.
    Texts whose lengths, or whose counts of characters, can't reach the best are passed over."""
    best: tuple[int, float] | None = None
    own = np.bincount(codes(text) % 4096, minlength=4096)
    for k, other in enumerate(among):
        total = len(text) + len(other)
        bar = max(least, best[1]) if best else least
        # the bounds allow for rounding; what they let through is computed
        if total and 2 * min(len(text), len(other)) / total < bar:
            continue
        if total and 2 * int(np.minimum(own, np.bincount(codes(other) % 4096, minlength=4096)).sum()) / total < bar:
            continue
        ratio = similarity(other, text)
        if ratio >= least and (best is None or ratio > best[1]):
            best = (k, ratio)
    return best
