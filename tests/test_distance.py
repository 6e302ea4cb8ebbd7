"""Edit distances against the plain table, near and far, over one word's band and beyond it."""

import random
import time

import pytest

from pagewright.functions import distance


def table(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def edited(r, text, letters, n):
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out) + 1)
        out[k : k + r.randrange(2)] = r.choice(letters) if r.random() < 0.7 else ""
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdéüß ", "กขคa😀b"])
def test_distances(letters):
    r = random.Random(3)
    old = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 31, 32, 33, 63, 64, 65, 130, 200]))) for _ in range(200)]
    new = [edited(r, x, letters, r.choice([0, 1, 3, 10, 40])) for x in old]
    new[::9] = ["".join(r.choice(letters) for _ in range(r.choice([0, 3, 50]))) for _ in new[::9]]
    want = [table(a, b) for a, b in zip(old, new, strict=True)]
    assert distance.distances([*old, None, "a"], [*new, "a", None]) == [*want, None, None]
    for near in (1, 5, 124):
        assert [distance.whole(a, b, near) for a, b in zip(old, new, strict=True)] == want


def test_long_lines_in_time():
    r = random.Random(5)
    a = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    b = "x" + a[7:30_000] + "yy" + a[30_000:]
    start = time.monotonic()
    assert distance.distances([a], [b]) == [9]
    assert time.monotonic() - start < 20
    assert distance.distances(["a" * 5000], ["b" * 5003]) == [5003]
