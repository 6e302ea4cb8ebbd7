"""Edit distance of two texts in code points, by bit-parallel columns.

Texts that are alike stay near the diagonal: a band of 64 rows that moves down with
each column holds in one word what distances up to 31 need, and many pairs take each
step together.  Pairs that are further apart, or too long to be laid out side by
side, get a wider band, or whole columns, as one number of as many bits.
"""

from __future__ import annotations

import numpy as np

#: The largest distance in a band of one word, the pairs that take a step together, the longest text laid out with others.
NEAR, TOGETHER, LAID_OUT = 31, 512, 4096


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def whole(a: str, b: str, near: int = 4 * NEAR) -> int:
    """The distance by columns of all rows within ``near`` of the diagonal; where it is larger, within twice as many."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    values, at = np.unique(_codes(b), return_inverse=True)
    rows = {chr(v): int.from_bytes(np.packbits(at == i, bitorder="little").tobytes(), "little") for i, v in enumerate(values.tolist())}
    while near < len(b):
        if len(b) - len(a) <= near and (distance := _in_band(a, b, rows, near)) <= near:
            return distance
        near *= 2
    ones, last = (1 << len(b)) - 1, len(b) - 1
    up, down, distance = ones, 0, len(b)
    for c in a:
        same = rows.get(c, 0)
        d0 = (((same & up) + up) ^ up) | same | down
        right, left = down | (ones & ~(d0 | up)), d0 & up
        distance += (right >> last & 1) - (left >> last & 1)
        right = (right << 1) | 1
        up = ((left << 1) | ~(d0 | right)) & ones
        down = right & d0 & ones
    return distance


def _in_band(a: str, b: str, rows: dict[str, int], near: int) -> int:
    """As one pair of ``_banded``, given up where it can't be ``near``, with numbers of 2 * near + 2 bits: b's rows, a's columns."""
    width = 2 * near + 2
    ones, last = (1 << width) - 1, width - 1
    rows = {c: v << (width - 1 - near) for c, v in rows.items()}
    # a step along the last row takes one off at most
    lost = 2 * near + len(a) - len(b)
    up, down, distance, turn = ones >> (width - 1 - near) << (width - 1 - near), 0, near, len(b) - near
    for i, c in enumerate(a):
        same = rows.get(c, 0) >> i & ones
        d0 = ((((same & up) + up) ^ up) | same | down) & ones
        right, left = down | (ones & ~(d0 | up)), d0 & up
        if i < turn:
            distance += not d0 >> last
            if distance > lost:
                return distance
        else:
            at = last - 1 - (i - turn)
            distance += (right >> at & 1) - (left >> at & 1)
        d0 >>= 1
        up, down = left | (ones & ~(d0 | right)), d0 & right
    return distance


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distances of pairs, the longer text first; those above ``NEAR`` may come out larger, never smaller."""
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    near = np.minimum(NEAR, n)
    top = max((int(x.max()) for p in pairs for x in p if len(x)), default=0)
    kind = np.uint8 if top < 254 else np.uint16 if top < 65534 else np.uint32
    steps = int(m.max())
    # column i and the 63 after it are the rows of step i; what stands outside a text is like nothing
    rows = np.full((len(pairs), max(int(n.max()), steps) + 128), np.iinfo(kind).max, kind)
    columns = np.full((len(pairs), steps), np.iinfo(kind).max - 1, kind)
    for g, (a, b) in enumerate(pairs):
        rows[g, 63 - near[g] : 63 - near[g] + len(a)] = a
        columns[g, : len(b)] = b
    one, last = np.uint64(1), np.uint64(63)
    up = np.uint64(2**64 - 1) << (63 - near).astype(np.uint64)
    down = np.zeros(len(pairs), np.uint64)
    distance, turn = near.astype(np.int64), n - near
    for i in range(steps):
        same = np.packbits((rows[:, i : i + 64] == columns[:, i : i + 1]).ravel(), bitorder="little").view(np.uint64)
        d0 = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(d0 | up), d0 & up
        # down the diagonal to the last row, then along it
        at = np.clip(62 - (i - turn), 0, 63).astype(np.uint64)
        along = (right >> at & one).astype(np.int64) - (left >> at & one).astype(np.int64)
        step = np.where(i < turn, 1 - (d0 >> last).astype(np.int64), along)
        distance += np.where(i < m, step, 0)
        d0 >>= one
        up, down = left | ~(d0 | right), d0 & right
    return distance


def distances(old: list[str | None], new: list[str | None]) -> list[int | None]:
    """The distance of each pair, null where a text is."""
    out: list[int | None] = [None] * len(old)
    sized, rest = [], []
    for k, (a, b) in enumerate(zip(old, new, strict=True)):
        if a is None or b is None:
            continue
        if not a or not b:
            out[k] = len(a) + len(b)
        elif abs(len(a) - len(b)) <= NEAR and max(len(a), len(b)) <= LAID_OUT:
            sized.append((max(len(a), len(b)), k))
        else:
            rest.append(k)
    sized.sort()
    for s in range(0, len(sized), TOGETHER):
        own = [k for _, k in sized[s : s + TOGETHER]]
        pairs = [(_codes(old[k]), _codes(new[k])) for k in own]
        for k, d in zip(own, _banded([(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]).tolist(), strict=True):
            if d <= NEAR:
                out[k] = d
            else:
                rest.append(k)
    for k in rest:
        out[k] = whole(old[k], new[k])
    return out
