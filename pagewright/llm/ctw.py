"""Language-model scores by context-tree weighting over bytes.

A text's tokens are its lower-cased (A-Z) words and one end; the model sees their
bytes, a blank after each word but the last and a line feed for the end.  Each
byte is eight binary decisions.  Every context of 0 to ``DEPTH`` bytes before it
and every prefix of its bits has a Krichevsky-Trofimov estimator, whose block
probability follows from the training counts alone; context-tree weighting mixes
the estimators of all depths along a context's path:

    P(d) = 1/2 KT(d) + 1/2 product of P(d + 1) over the contexts one byte longer

so the predictive probability of a bit is the mixture of the depths' estimates by
weights KT(d) / (KT(d) + product).  A context that training never met has no
counts, so it predicts one half and weighs its depth by one half, as every
Krichevsky-Trofimov estimator does before its first symbol.  Scoring uses the
trained tree as it is.

No executor and not the driver ever holds the tree:

1. Documents are dealt into buckets of about ``BUCKET_BYTES``.  A bucket sums
   its distinct (context, byte) pairs and words, with their counts in its
   training documents, and sends them to the shards that own them: a shard owns
   all contexts that end in the same ``depth - 2`` bytes, at most 65,536 of full
   depth for each such ending, however large the input; a word goes by its hash.
2. A shard sums the counts of all buckets and weights its subtrees.
3. The nodes of the shallower depths are summed natively by (context, prefix),
   one depth at a time; only the 256 contexts of depth 1, with 255 nodes each at
   most, come to the driver.  Back down, each node gets what the depths above it
   contribute and the weight that they leave.
4. Each shard answers every bucket with the code length of each pair it asked
   for, and the bucket scores its documents whole.

Pairs and counts travel as sorted 64-bit entries, as differences in byte planes,
which the shuffle's compression reduces to a few bytes each.

Defined cases: null and empty texts are one token, the end; a null id counts as
an empty one for the fold; repeated rows are scored (and learned from) each, and
share a bucket; equal texts have equal scores, so ties need no order; a text is
scored whole however long it is, in the memory of one bucket and itself; a word
may hold any character but the six blanks, U+0000 too; other columns of the
input are ignored, whatever they are called; an empty table gives an empty
result; without training documents all estimates are those of an untrained tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_only, materialize, mix64, slices, trim

#: Bytes of context, 6 at most: with the byte itself and a count they fill 64 bits.
DEPTH = 6
BUCKET_BYTES = 16 << 20
SHARD_BYTES = 16 << 20
CHUNK = 2 << 20
#: Positions whose keys are made and looked up at once; they stay in a core's cache.
LOOK = 1 << 16
WORDS, GRAMS, MODEL, UP = 0, 1, 2, 3
#: The end's word in messages; no other word holds a line feed.
END = b"\n"
_BYTE = np.uint64(255)


def held_out(id_col: Column) -> Column:
    """The contract's fold: a seventh of all ids."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


_FEW = 1 << 14
_HALVES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_FEW - 1) + 0.5))))
_WHOLES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_FEW - 1) + 1.0))))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones: products
    of halves over a factorial, from tables, or Stirling's series for large counts."""
    return _log_rising(n0, 0.5, _HALVES) + _log_rising(n1, 0.5, _HALVES) - _log_rising(n0 + n1, 1.0, _WHOLES)


def _log_rising(n: np.ndarray, x: float, table: np.ndarray) -> np.ndarray:
    """Log of x (x + 1) ... (x + n - 1)."""
    n = np.asarray(n)
    out = table[np.minimum(n, _FEW - 1).astype(np.int64)]
    many = n >= _FEW
    if many.any():
        series = lambda z: (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z)
        out = np.where(many, series(np.maximum(n, 1) + x) - (0.5 * np.log(np.pi) if x == 0.5 else 0.0), out)
    return out


def grams(data: np.ndarray, begin: int, end: int, depth: int) -> np.ndarray:
    """(context, byte) of the bytes that stand ``depth`` after the places from ``begin`` to
    ``end``, eight bits a byte, the latest context byte next to the lowest eight.
    Eight bytes are read at each place, so ``data`` has some to spare."""
    key = np.ndarray((end - begin,), ">u8", data, begin, (1,)).astype(np.uint64)
    key >>= np.uint64(8 * (7 - depth))
    return key


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values in a sorted array."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


def entries(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sorted distinct keys with their counts in the lowest byte; a key of a larger
    count has several entries that add up to it."""
    out = keys << np.uint64(8)
    large = np.flatnonzero(n > 255)
    if not len(large):
        out |= n.view(np.uint64)
        return out
    more = (n[large] - 1) // 255
    further = np.repeat(out[large] | _BYTE, more)
    out |= np.minimum(n, 255).view(np.uint64)
    out[large] = keys[large] << np.uint64(8) | (n[large] - 255 * more).view(np.uint64)
    out = np.concatenate([out, further])
    out.sort()
    return out


def counted(parts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of several arrays of entries, sorted, and their counts."""
    every = np.concatenate(parts)
    every.sort()
    keys = every >> np.uint64(8)
    first, _ = runs(keys)
    keys = keys[first]
    every &= _BYTE
    return keys, np.add.reduceat(every, first).view(np.int64) if len(first) else first


def planes(x: np.ndarray) -> bytes:
    """The bytes of all numbers, lowest bytes first: high ones, mostly zero, compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, np.uint64), dtype=np.uint64)


def packed_words(words: list[bytes]) -> bytes:
    return END.join(w if w != END else b"" for w in words)


def unpacked_words(raw: bytes) -> list[bytes]:
    """A word is never empty and holds no line feed; the empty one stands for the end."""
    return [w or END for w in raw.split(END)]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def laid_out(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The bytes of the model's texts, each behind ``depth`` line feeds and all before eight
    bytes to spare, and where in them the line feeds before all texts but the first are; the
    words of all texts in turn; each text's numbers of words and of bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    own = ~_BLANK[raw]
    # a word's first byte has a blank or another text before it, its last byte after it
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    edge = ends[:-1][ends[:-1] < len(raw)]
    first[edge] = own[edge]
    edge = ends[1:][ends[1:] > 0] - 1
    last[edge] = own[edge]
    first = np.flatnonzero(first)
    size = np.flatnonzero(last)
    size -= first
    size += 1
    del last
    text = np.searchsorted(ends[1:], first, side="right")
    n_words = np.bincount(text, minlength=len(texts))
    letters, offsets = _LOWER[raw[own]], np.r_[0, np.cumsum(size)]
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)])
    n_bytes = np.diff(offsets[np.r_[0, np.cumsum(n_words)]]) + np.maximum(n_words, 1)
    begins = np.r_[0, np.cumsum(n_bytes + depth)]
    # before the separator behind a word are all letters up to it and a separator for each word
    # before it, line feeds before its text and those before it, and the ends of empty texts
    after = offsets[1:] + np.arange(len(size)) + (depth * np.arange(1, len(texts) + 1) + np.r_[0, np.cumsum(n_words == 0)[:-1]])[text]
    data, of_word = np.full(begins[-1] + 8, 10, np.uint8), np.ones(begins[-1] + 8, bool)
    before = (begins[:-1, None] + np.arange(depth)).ravel()
    of_word[before] = False
    of_word[begins[1:] - 1] = False
    of_word[after] = False
    of_word[-8:] = False
    data[of_word] = letters
    data[after] = 32
    data[begins[1:] - 1] = 10
    return data, before[depth:], words, n_words, n_bytes


def spelt(words: pa.Array) -> list[bytes]:
    """Words of an array, none of which is empty or holds a line feed."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), END)[0].as_py()
    return joined.split(END) if len(words) else []


class Places:
    """Where keys stand in a sorted array of distinct ones that has them all.

    A table has the place of each key whose slot no other key has; the others go on to the
    next table, and few are left to search for.  A key that isn't there gets any place."""

    #: Odd factors whose products' high bits are slots.
    FACTORS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)))

    def __init__(self, keys: np.ndarray):
        self.tables, at = [], np.arange(len(keys), dtype=np.int32)
        for factor in self.FACTORS:
            bits = max(int(2 * len(keys)).bit_length(), 4)
            shift = np.uint64(64 - bits)
            table, more = np.full(1 << bits, -1, np.int32), np.ones(len(keys), bool)
            blocks = [slice(i, i + LOOK) for i in range(0, len(keys), LOOK)]
            slot = lambda own: ((keys[own] * factor) >> shift).view(np.int64)  # noqa: B023, E731
            for own in blocks:
                table[slot(own)] = at[own]
            for own in blocks:
                x = slot(own)
                # a slot that another key has taken is nobody's
                table[x[table[x] != at[own]]] = -1
            for own in blocks:
                more[own] = table[slot(own)] < 0
            self.tables.append((factor, shift, table))
            keys, at = keys[more], at[more]
        self.keys, self.at = keys, at

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = more = None
        for factor, shift, table in self.tables:
            got = table[((keys * factor) >> shift).view(np.int64)]
            if out is None:
                out, more = got, np.flatnonzero(got < 0)
                keys = keys[more]
            else:
                out[more] = got
                lost = got < 0
                keys, more = keys[lost], more[lost]
        if len(self.keys):
            out[more] = self.at[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)]
        return out


class Bucket:
    """The documents of one bucket, and what it asks for: the bytes of their texts, laid out a
    chunk of documents at a time, and numbers of their words.  Keys are made of the bytes
    whenever they are needed, a few at a time."""

    def __init__(self, table: pa.Table, shards: int, depth: int):
        self.shards, self.depth, self.chunks, words = shards, depth, [], []
        for batch in slices(table.select(["doc_id", "text", "held_out"]).to_batches(), "text", CHUNK):
            data, padding, own, n_words, n_bytes = laid_out(batch.column(1), depth)
            self.chunks.append((batch.column(0), batch.column(2), data, padding, n_words, n_bytes))
            words.append(own.dictionary_encode())
            del own
        coded = pa.chunked_array(words).unify_dictionaries()
        del words
        self.words = [x.indices.to_numpy() for x in coded.chunks]
        #: The distinct words in the order of their numbers, the end as the last one.
        self.named = [*spelt(coded.chunk(0).dictionary), END]
        del coded
        trim()

    def keys(self, data: np.ndarray, padding: np.ndarray) -> Iterator[np.ndarray]:
        """The keys of a chunk's bytes but those before texts."""
        size = len(data) - 8 - self.depth
        for i in range(0, size, LOOK):
            j = min(i + LOOK, size)
            a, b = np.searchsorted(padding, (i + self.depth, j + self.depth))
            keys = grams(data, i, j, self.depth)
            yield np.delete(keys, padding[a:b] - (i + self.depth)) if a < b else keys

    def found(self) -> np.ndarray:
        """All distinct keys, sorted.  A table of those met last keeps most repeated ones from being sorted."""
        last, shift, factor = np.full(1 << 18, ~np.uint64(0)), np.uint64(64 - 18), Places.FACTORS[0]
        held, new, size = [], [], 0
        for *_, data, padding, _, _ in self.chunks:
            for keys in self.keys(data, padding):
                slot = ((keys * factor) >> shift).view(np.int64)
                new.append(keys[last[slot] != keys])
                last[slot] = keys
                size += len(new[-1])
                if size >= SORTED:
                    held.append(distinct(new))
                    new, size = [], 0
                    # like sizes are merged, so a key is moved a few times and the rest stays small
                    while len(held) > 1 and 2 * len(held[-1]) >= len(held[-2]):
                        held[-2:] = [distinct(held[-2:])]
        del last
        out = distinct([*held, *new])
        del held, new
        trim()
        return out

    def asked_words(self) -> np.ndarray:
        """Training counts of the words."""
        out = np.zeros(len(self.named), np.int64)
        for (_, folds, _, _, many, _), words in zip(self.chunks, self.words, strict=True):
            train = trained(folds)
            out += np.bincount(words[np.repeat(train, many)], minlength=len(out))
            out[-1] += train.sum()
        return out

    def asked_keys(self) -> np.ndarray:
        """The sorted entries of all keys."""
        found = self.found()
        places, n = Places(found), np.zeros(len(found), np.int64)
        for _, folds, data, padding, _, n_bytes in self.chunks:
            at, train = 0, np.repeat(trained(folds), n_bytes)
            for keys in self.keys(data, padding):
                np.add.at(n, places(keys)[train[at : at + len(keys)]], 1)
                at += len(keys)
        del places
        return entries(found, n)

    def by_shard(self) -> Iterator[tuple[int, np.ndarray]]:
        """Shards with the numbers of their words, in the same order whatever the numbers are."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.named), np.uint64, len(self.named))
        order = np.argsort(hashes)
        if (hashes[order[1:]] == hashes[order[:-1]]).any():
            order = np.array(sorted(range(len(hashes)), key=lambda i: (int(hashes[i]), self.named[i])))
        for s, own in grouped((hashes[order] % np.uint64(self.shards)).astype(np.int64)):
            yield s, order[own]


def trained(folds: pa.Array) -> np.ndarray:
    return ~folds.to_numpy(zero_copy_only=False).astype(bool)


#: Keys that are sorted together at first.
SORTED = 1 << 20


def grouped(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with its places, in their order."""
    order = np.argsort(shard, kind="stable")
    first, n = runs(shard[order])
    for at, many in zip(first.tolist(), n.tolist(), strict=True):
        own = order[at : at + many]
        yield int(shard[own[0]]), own


def dealt(keys: np.ndarray, shards: int, depth: int, low: int = 8) -> Iterator[tuple[int, np.ndarray]]:
    """Shards with the places of their keys, by the last bytes of the context; ``low``: the
    bits below it."""
    shard = np.empty(len(keys), np.uint16 if shards < 1 << 16 else np.int64)
    for i in range(0, len(keys), LOOK):
        ending = keys[i : i + LOOK] >> np.uint64(low) & np.uint64((1 << 8 * max(depth - 2, 1)) - 1)
        shard[i : i + LOOK] = mix64(ending) % np.uint64(shards)
    yield from grouped(shard)


_TYPES = {"shard": pa.int64(), "kind": pa.int32(), "bucket": pa.int64(), "asked": pa.binary(), "counts": pa.binary(), "code": pa.int64(), "zeros": pa.float64(), "ones": pa.float64(), "log_p": pa.float64(), "n": pa.int64(), "v": pa.int64()}
_ROW = "shard long, kind int, bucket long, asked binary, counts binary, code long, zeros double, ones double, log_p double, n long, v long"
_ASK = "shard long, kind int, bucket long, asked binary, counts binary"


def rows_of(columns: dict, size: int, names: list[str] | None = None) -> pa.Table:
    """A table with the given columns and nulls in the others."""
    names = names or list(_TYPES)
    return pa.table({k: pa.array(columns[k], _TYPES[k]) if k in columns else pa.nulls(size, _TYPES[k]) for k in names})


def ask(shards: int, depth: int):
    def run(table: pa.Table) -> pa.Table:
        trim()
        bucket, at = Bucket(table, shards, depth), table.column("bucket")[0].as_py()
        n_words = bucket.asked_words()
        out = [(s, WORDS, packed_words([bucket.named[i] for i in own.tolist()]), planes(n_words[own].view(np.uint64))) for s, own in bucket.by_shard()]
        bucket.named, bucket.words = [], []
        found = bucket.asked_keys()
        del bucket
        out += [(s, GRAMS, packed_keys(found[own]), None) for s, own in dealt(found, shards, depth, 16)]
        del found
        trim()
        shard, kind, asked, n = zip(*out, strict=True)
        return rows_of({"shard": shard, "kind": kind, "bucket": [at] * len(out), "asked": asked, "counts": n}, len(out), _ASK_NAMES)

    return run


_ASK_NAMES = [x.split()[0] for x in _ASK.split(", ")]


def weigh(keys: np.ndarray, counts: np.ndarray, depth: int, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed estimates of each key's eight bits from depth ``root`` on, and the sums
    of depth ``root``'s nodes by their parents: code, n0, n1, log P.  ``keys``:
    sorted and distinct."""
    leaf, n, to_leaf = keys, counts.astype(float), np.arange(len(keys))
    out, below, sums = np.empty((8, len(keys)), np.float32), [], []
    for d in range(depth, root - 1, -1):
        up = None
        if d < depth:
            code = leaf & np.uint64((1 << 8 * (d + 1)) - 1)
            order = np.argsort(code, kind="stable")
            first, size = runs(code[order])
            up = np.empty(len(code), np.int64)
            up[order] = np.repeat(np.arange(len(first)), size)
            leaf, n, to_leaf = code[order][first], np.bincount(up, n, len(first)), up[to_leaf]
        sums = []
        for j in range(8):
            first, size = runs(leaf >> np.uint64(8 - j))
            one = (leaf >> np.uint64(7 - j) & np.uint64(1)).astype(float)
            ones, total = np.add.reduceat(n * one, first), np.add.reduceat(n, first)
            log_e, e = log_kt(total - ones, ones), (ones + 0.5) / (total + 1)
            node = np.repeat(np.arange(len(first)), size)
            own = np.where((keys >> np.uint64(7 - j) & np.uint64(1)).astype(bool), e[node[to_leaf]], 1 - e[node[to_leaf]])
            if up is None:
                log_p, out[j] = log_e, own
            else:
                start, deeper = below[j]
                children = np.bincount(node[up[start]], deeper, len(first))
                log_p = np.logaddexp(log_e, children) - np.log(2)
                share = (1 / (1 + np.exp(np.clip(children - log_e, -700, 700))))[node[to_leaf]]
                out[j] = share * own + (1 - share) * out[j]
            sums.append((first, log_p, total - ones, ones))
        below = [(first, log_p) for first, log_p, _, _ in sums]
    codes, rest = [], []
    mask = np.uint64((1 << 8 * (root - 1)) - 1)
    for j, (first, log_p, zeros, ones) in enumerate(sums):
        x = leaf[first]
        codes.append((x >> np.uint64(8) & mask) << np.uint64(8) | np.uint64(1 << j) | (x & _BYTE) >> np.uint64(8 - j))
        rest.append((zeros, ones, log_p))
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    zeros, ones, log_p = (np.bincount(place, np.concatenate([r[i] for r in rest]), len(code)) for i in range(3))
    return out, code, zeros, ones, log_p


def weighted(depth: int):
    """One kind of one shard: the counts of all buckets summed.  Words are answered
    at once; pairs become the shard's model and its contributions to the depths above."""
    root = max(depth - 2, 1)

    def run(table: pa.Table) -> pa.Table:
        trim()
        shard, kind = table.column("shard")[0].as_py(), table.column("kind")[0].as_py()
        buckets, asked = table.column("bucket").to_pylist(), table.column("asked").to_pylist()
        if kind == WORDS:
            counts = [unplaned(x, np.uint64) for x in table.column("counts").to_pylist()]
            split, total = [unpacked_words(x) for x in asked], {}
            for words, n in zip(split, counts, strict=True):
                for w, c in zip(words, n.tolist(), strict=True):
                    total[w] = total.get(w, 0) + c
            answers = [planes(np.fromiter(map(total.__getitem__, words), np.uint64, len(words))) for words in split]
            return pa.concat_tables([rows_of({"shard": [shard] * len(buckets), "kind": [WORDS] * len(buckets), "bucket": buckets, "asked": answers}, len(buckets)), rows_of({"n": [sum(total.values())], "v": [sum(n > 0 for n in total.values())]}, 1)])
        del table
        keys, n = counted([unpacked_keys(x) for x in asked])
        p, code, zeros, ones, log_p = weigh(keys, n, depth, root)
        model = rows_of({"shard": [shard], "kind": [MODEL], "asked": [packed_keys(keys)], "counts": [p.tobytes()]}, 1)
        size = len(code)
        return pa.concat_tables([model, rows_of({"shard": [shard] * size, "kind": [UP] * size, "code": code.astype(np.int64), "zeros": zeros, "ones": ones, "log_p": log_p}, size)])

    return run


def answered(depth: int):
    """One shard: the log10 probability of each pair, for each bucket that asked."""
    root = max(depth - 2, 1)

    def run(table: pa.Table) -> pa.Table:
        trim()
        names = ["shard", "kind", "bucket", "asked"]
        kind = table.column("kind").to_numpy()
        top = table.filter(pa.array(kind == UP))
        order = np.argsort(top.column("code").to_numpy(), kind="stable")
        code, acc, rem = (top.column(c).to_numpy()[order] for c in ("code", "zeros", "ones"))
        model = table.filter(pa.array(kind == MODEL)).slice(0, 1)
        keys = unpacked_keys(model.column("asked")[0].as_py())
        p = np.frombuffer(model.column("counts")[0].as_py(), np.float32).reshape(8, -1)
        above = (keys >> np.uint64(8) & np.uint64((1 << 8 * (root - 1)) - 1)) << np.uint64(8)
        out = np.zeros(len(keys))
        for j in range(8):
            at = np.searchsorted(code, (above | np.uint64(1 << j) | (keys & _BYTE) >> np.uint64(8 - j)).astype(np.int64))
            one = (keys >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            left = rem[at]
            out += np.log10(np.where(one, acc[at], 1 - left - acc[at]) + left * p[j])
        out = out.astype(np.float32)
        asks = table.filter(pa.array(kind == GRAMS))
        shard, buckets = asks.column("shard").to_pylist(), asks.column("bucket").to_pylist()
        replies = [out[np.searchsorted(keys, distinct([unpacked_keys(x) >> np.uint64(8)]))].tobytes() for x in asks.column("asked").to_pylist()]
        return rows_of({"shard": shard, "kind": [GRAMS] * len(shard), "bucket": buckets, "asked": replies}, len(shard), names)

    return run


def own_log_p(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with the sum of their children's log P: their own log P and weight added."""
    for b in batches:
        zeros, ones, children = (b.column(c).to_numpy() for c in ("zeros", "ones", "children"))
        log_e = log_kt(zeros, ones)
        share = 1 / (1 + np.exp(np.clip(children - log_e, -700, 700)))
        yield pa.RecordBatch.from_arrays([b.column("code"), pa.array(zeros), pa.array(ones), pa.array(np.logaddexp(log_e, children) - np.log(2)), pa.array(share), pa.array((ones + 0.5) / (zeros + ones + 1))], ["code", "zeros", "ones", "log_p", "share", "e"])


_NODE = "code long, zeros double, ones double, log_p double, share double, e double"


def summed(rows: DataFrame) -> DataFrame:
    """Nodes by code, from rows of their children."""
    return rows.groupBy("code").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_p").alias("children")).mapInArrow(own_log_p, _NODE)


def parent(d: int) -> Column:
    """The code of the node one byte shorter than a node of depth ``d``."""
    context = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))
    return F.shiftleft(context, 8).bitwiseOR(F.col("code").bitwiseAND(F.lit(255)))


def descended(up: DataFrame, root: int) -> tuple[DataFrame, list[DataFrame]]:
    """code, acc, rem of each node of depth ``root`` - 1: what the depths up to its
    own say of a one, and the weight that they leave to those below."""
    levels = {root - 1: materialize(summed(up.select("code", "zeros", "ones", "log_p")), "nodes")}
    for d in range(root - 2, 0, -1):
        levels[d] = materialize(summed(levels[d + 1].select(parent(d + 1).alias("code"), "zeros", "ones", "log_p")), "nodes")
    # 256 contexts of 255 nodes at most, or the 255 of the empty context
    low = min(1, root - 1)
    top = levels[low].toPandas()
    bits = top["code"].to_numpy(np.int64) & 255
    zeros, ones, log_p = (np.bincount(bits, top[c].to_numpy(float), 256) for c in ("zeros", "ones", "log_p"))
    log_e = log_kt(zeros, ones)
    share = 1 / (1 + np.exp(np.clip(log_p - log_e, -700, 700)))
    acc, rem = share * (ones + 0.5) / (zeros + ones + 1), 1 - share
    if low == 0:  # the nodes found are the empty context's own
        own = top["share"].to_numpy(float)
        top["acc"], top["rem"] = own * top["e"], 1 - own
    else:
        top["acc"], top["rem"] = acc[bits] + rem[bits] * top["share"] * top["e"], rem[bits] * (1 - top["share"])
    spark = up.sparkSession
    done = spark.createDataFrame(top[["code", "acc", "rem"]], "code long, acc double, rem double")
    for d in range(2, root):
        over = done.select(F.col("code").alias("over"), F.col("acc").alias("a"), F.col("rem").alias("r"))
        done = levels[d].withColumn("over", parent(d)).join(over, "over").select("code", (F.col("a") + F.col("r") * F.col("share") * F.col("e")).alias("acc"), (F.col("r") * (1 - F.col("share"))).alias("rem"))
    return done, list(levels.values())


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, log_counts double, score double"
_SCORE_TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def distinct(parts: Sequence[np.ndarray]) -> np.ndarray:
    every = np.concatenate(parts)
    every.sort()
    new = np.ones(len(every), bool)
    np.not_equal(every[1:], every[:-1], out=new[1:])
    return every[new]


def score(shards: int, depth: int):
    """One bucket's documents: when the bucket's distinct words and keys are known, so is what
    each answer is for, and then each word and each byte's key finds its own."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _SCORE.split(", ")]
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in _SCORE_TYPES], names=names)
        trim()
        bucket = Bucket(table, shards, depth)
        del table
        got = dict(zip(zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), strict=True), answers.column("asked"), strict=True))
        counts = np.zeros(len(bucket.named), np.int64)
        for s, own in bucket.by_shard():
            counts[own] = unplaned(got[WORDS, s].as_buffer(), np.uint64)
        bucket.named = []
        found = bucket.found()
        log_p = np.empty(len(found), np.float32)
        for s, own in dealt(found, shards, depth):
            log_p[own] = np.frombuffer(got[GRAMS, s].as_buffer(), np.float32)
        del got, answers
        places = Places(found)
        del found
        known, logs = (counts > 0).astype(float), np.log10(counts + 1.0)
        trim()
        out = []
        for (ids, folds, data, padding, n_words, n_bytes), words in zip(bucket.chunks, bucket.words, strict=True):
            value, at = np.empty(n_bytes.sum(), np.float32), 0
            for keys in bucket.keys(data, padding):
                value[at : at + len(keys)] = log_p[places(keys)]
                at += len(keys)
            text = np.repeat(np.arange(len(ids)), n_words)
            n_known, log_counts = (np.bincount(text, x[words], len(ids)) + x[-1] for x in (known, logs))
            columns = (ids, folds, n_words + 1, np.rint(n_known).astype(np.int64), n_bytes, log_counts, np.add.reduceat(value, np.r_[0, np.cumsum(n_bytes)[:-1]], dtype=np.float64))
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _SCORE_TYPES, strict=True)], names=names))
        del bucket, places, log_p, data, value, words
        trim()
        return pa.Table.from_batches(out)

    return run


def ctw_scores(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, n_bytes, train_tokens, train_words,
    base_score, score (log10) and bits_per_byte of each row of ``docs``; ``depth``:
    1 to 6 bytes of context."""
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6: a context, its byte and a count are one 64-bit entry")
    docs = documents_only(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a small input is spread over the cores, a large one goes by size alone
    least = min(docs.sparkSession.sparkContext.defaultParallelism, int(total >> 20) + 1)
    buckets, shards = max(least, int(total // BUCKET_BYTES) + 1), max(least, int(total // SHARD_BYTES) + 1)
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(buckets)))
    asked = materialize(docs.groupBy("bucket").applyInArrow(ask(shards, depth), _ASK), "asked")
    found = materialize(asked.groupBy("shard", "kind").applyInArrow(weighted(depth), _ROW), "shards")
    up = found.where(F.col("kind") == UP).select("shard", "code", "zeros", "ones", "log_p")
    root = max(depth - 2, 1)
    top, levels = descended(up, root)
    down = up.select("shard", "code").join(top, "code").select("shard", F.lit(UP).alias("kind"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("asked"), F.lit(None).cast("binary").alias("counts"), "code", F.col("acc").alias("zeros"), F.col("rem").alias("ones"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("code", "long"), ("zeros", "double"), ("ones", "double"))]
    asks = asked.where(F.col("kind") == GRAMS).select("shard", "kind", "bucket", "asked", F.lit(None).cast("binary").alias("counts"), *empty)
    models = found.where(F.col("kind") == MODEL).select("shard", "kind", "bucket", "asked", "counts", *empty)
    answers = materialize(asks.unionByName(models).unionByName(down).groupBy("shard").applyInArrow(answered(depth), "shard long, kind int, bucket long, asked binary"), "answers")
    n, v = (x or 0 for x in found.agg(F.sum("n"), F.sum("v")).first())
    replies = answers.unionByName(found.where(F.col("kind") == WORDS).select("shard", "kind", "bucket", "asked"))
    out = docs.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(score(shards, depth), _SCORE)
    discard(asked, *levels)
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "n_bytes", F.lit(int(n)).cast("long").alias("train_tokens"), F.lit(int(v)).cast("long").alias("train_words"), base.alias("base_score"), "score", (-F.col("score") * np.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def op2_context_tree_scores(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, and bytes and code length per byte."""
    return ctw_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
