"""Packing token sequences into windows by minimum bin slack.

Every document is tokenized once and cut into full windows and one remainder,
so a piece is described by its length alone and the whole corpus by a histogram
of at most ``window`` lengths, whatever its size.  On that histogram the driver
runs minimum bin slack: of the longest length left, a bitset subset-sum dynamic
program over the remaining multiset finds the lengths whose sum comes closest to
the window, backtracking gives the counts, and that filling is used as often as
the counts allow.  Each round uses up a length at least, so the work depends on
the window and not on the corpus.  Pieces then find their place by their rank
among the pieces of their length.

Ranks are taken in salted groups of a length whose sizes are summed first, so a
length that many pieces share stays spread out; the salts grow with the pieces.

Defined cases: a null or empty text is a document of the end token alone; repeated ids and
rows are packed once each; pieces that tie in length are ranked by id, start and checksum, and
equal ones are interchangeable; a very long text is tokenized whole, in one batch of its own;
other columns are ignored, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents_only, materialize, slices

#: Pieces of one length that one task ranks, about.
RANKED = 100_000
LEAST_SALTS = 64
#: Parts whose ids one Python worker remembers, about 30 bytes each.
MEMORY = 1_000_000


class PartIds:
    """The ids of texts by way of distinct parts.

    Where the tokenizer lower-cases and splits by a plain pattern, the parts of
    a batch of texts by that pattern are encoded as a dictionary; each part of it
    that isn't remembered is tokenized once, and the texts' ids are gathered.
    Other tokenizers, and texts beyond Latin-1 or with blanks or special tokens
    that a tokenizer may see differently, are tokenized as they are.
    """

    ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    #: Fixed value: the splitting rule that is understood, as the vocabulary file states it.
    RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; idle threads would spin
        self.tokenizer = Tokenizer.from_file(path)
        # what is remembered: parts, where their ids begin and how many they are, the ids, and when they were last met
        self.known, self.flat = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.first, self.count, self.met, self.now = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        self.ends = self._ends(json.loads(Path(path).read_text()))
        latin = [chr(i) for i in range(256)]
        number = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        other = "".join(f"\\x{{{ord(c):x}}}" for c in latin if unicodedata.category(c)[0] not in "LN" and not c.isspace() and c not in "\x1c\x1d\x1e\x1f")
        # with blanks around all but runs of letters, splitting at blanks gives the parts
        self.apart = f"('s|'t|'re|'ve|'m|'ll|'d|[{number}]|[{other}]+)"

    def _ends(self, t: dict) -> np.ndarray | None:
        """Which ids end a part, where the rule is the one understood."""
        steps = [x["type"] for x in (t["normalizer"] or {}).get("normalizers", [])]
        split = (t["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        suffix = t["model"].get("end_of_word_suffix")
        if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in split] != ["Split", "ByteLevel"] or not suffix:
            return None
        if split[0]["pattern"] != {"Regex": self.RULE} or split[0]["behavior"] != "Removed" or not split[0]["invert"] or split[1]["use_regex"] or split[1]["add_prefix_space"]:
            return None
        vocabulary = t["model"]["vocab"]
        ends = np.zeros(max([*vocabulary.values(), *(x["id"] for x in t["added_tokens"])]) + 1, bool)
        ends[[i for k, i in vocabulary.items() if k.endswith(suffix)]] = True
        return ends

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The parts' ids in a row, and how many each has."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(parts):
            return ids, np.diff(cuts, prepend=0)
        each = [self.whole(p) for p in parts]
        return np.concatenate(each), np.array(list(map(len, each)), np.int64)

    def _forget(self) -> None:
        """Of too many parts, those met lately stay."""
        keep = np.flatnonzero(self.met > np.partition(self.met, len(self.met) // 2)[len(self.met) // 2])
        size, start = self.count[keep], self.first[keep]
        upto = np.cumsum(size)
        self.flat = self.flat[np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        self.known, self.first, self.count, self.met = self.known.take(pa.array(keep)), upto - size, size, self.met[keep]

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where each part is among those remembered; new ones are tokenized in one go."""
        self.now += 1
        if len(self.known) > MEMORY:
            self._forget()
        at = pc.index_in(parts, value_set=self.known)
        fresh = parts.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            words = fresh.to_pylist()
            ids, size = self._encode([w for w in words if w])
            if "" in words:  # what splitting leaves at the ends
                size = np.insert(size, words.index(""), 0)
            at[at < 0] = len(self.known) + np.arange(len(fresh))
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
            self.known, self.flat = pa.concat_arrays([self.known, fresh]), np.concatenate((self.flat, ids))
            self.count, self.met = np.concatenate((self.count, size)), np.concatenate((self.met, np.zeros(len(fresh), np.int64)))
        self.met[at] = self.now
        return at

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(x in text for x in self.ODD)

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column; null is an empty text."""
        texts = [x or "" for x in column.to_pylist()]
        plain = [self.ends is not None and self._plain(t) for t in texts]
        own = pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.large_string())
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(own), self.apart, r" \1 "))
        coded = split.values.dictionary_encode() if len(own) else None
        out = []
        if coded is not None and len(coded):
            index = self._places(coded.dictionary)[coded.indices.to_numpy()]
            size, first = self.count[index], self.first[index]
            upto = np.concatenate(([0], np.cumsum(size)))
            ids = self.flat[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
            at = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
            out = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        else:
            out = [np.zeros(0, "<u4")] * len(own)
        rest = iter(out)
        return [next(rest) if p else self.whole(t) for t, p in zip(texts, plain, strict=True)]


_loaded: dict[str, PartIds] = {}


def part_ids(path: str) -> PartIds:
    if path not in _loaded:
        _loaded[path] = PartIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: a row for each full window and for what is left of a document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = part_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in slices(batches, "text", 4 << 20):
            rows = []
            for doc, own in zip(b.column(0).to_pylist(), known.texts(b.column(1)), strict=True):
                ids = own.tobytes() + last
                rows += [(doc, at // 4, min(window, (len(ids) - at) // 4), zlib.crc32(ids[at : at + 4 * window]), len(ids) // 4) for at in range(0, len(ids), 4 * window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents_only(docs, id_col, text_col).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: list[int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings (times, [(length, count), ...]) that use up ``counts`` (by length)."""
    left = list(counts) + [0] * (window + 1 - len(counts))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if left[window]:
        out.append((left[window], [(window, 1)]))
    mask = (1 << (window + 1)) - 1
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            room, picks = window - longest, {longest: 1}
            left[longest] -= 1
            # bitset of reachable sums, long lengths first, till the room is met exactly
            reach, steps = 1, []
            goal = 1 << room
            for length in range(min(longest, room), 0, -1):
                have, part = min(left[length], room // length), 1
                while have > 0:
                    part_ = min(part, have)
                    new = (reach | (reach << (part_ * length))) & mask & ((goal << 1) - 1)
                    if new != reach:
                        steps.append((reach, length, part_))
                        reach = new
                    have -= part_
                    part *= 2
                if reach & goal:
                    break
            at = reach.bit_length() - 1
            for before, length, part in reversed(steps):
                if not at:
                    break
                if not before >> at & 1:
                    picks[length] = picks.get(length, 0) + part
                    at -= part * length
            left[longest] += 1
            times = min(left[k] // c for k, c in picks.items())
            for k, c in picks.items():
                left[k] -= times * c
            out.append((times, sorted(picks.items(), reverse=True)))
    return out


def places(fillings: list[tuple[int, list[tuple[int, int]]]]) -> tuple[dict[int, np.ndarray], int]:
    """By length, rows (first rank, pieces a sequence, first sequence, offset) by rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, picks in fillings:
        offset = 0
        for length, count in picks:
            rows.setdefault(length, []).append((ranks.get(length, 0), count, sequence, offset))
            ranks[length] = ranks.get(length, 0) + times * count
            offset += length * count
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}, sequence


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = materialize(pieces(docs, tokenizer, end_id, window, id_col, text_col), "pieces")
    salts = max(LEAST_SALTS, -(-cut.count() // RANKED))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    by = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = by.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = [0] * (window + 1)
    for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect():  # window rows at most
        counts[r["length"]] = r["n"]
    table, _ = places(fill(counts, window))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (2, 5))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                k, t = int(length[own[0]]), table[int(length[own[0]])]
                row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                past = rank[own] - row[:, 0]
                seq[own], off[own] = row[:, 2] + past // row[:, 1], row[:, 3] + past % row[:, 1] * k
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("r", F.row_number().over(within)).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("r") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    """The installed vocabulary's place, on any machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bin_slack_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
