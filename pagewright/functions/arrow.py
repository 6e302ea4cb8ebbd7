"""Text functions that have no built-in: Arrow-batched, never a row at a time across the wire."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from string import ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from . import distance, matching

TEXT = StringType()  # types as objects: workers have no session to parse names with


def _text_udf(one, returns=TEXT):
    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run


def nfc(text: Column) -> Column:
    return _text_udf(lambda t: unicodedata.normalize("NFC", t))(text)


def casefold(text: Column) -> Column:
    return _text_udf(str.casefold)(text)


#: Characters of texts whose rows are handed on together.
TOGETHER = 1 << 18


def exploded(docs: DataFrame, column: str, schema: str, rows_of: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """doc_id and the rows that ``rows_of`` makes of each text.  They are handed on as they
    are made, so a worker holds those of few texts, however many texts come in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)

        def piece(ids: list, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, *zip(*rows, strict=True)), target, strict=True)], schema=target)

        for b in batches:
            ids, rows, size = [], [], 0
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py() or ""
                before = len(rows)
                rows += rows_of(text)
                ids += [doc.as_py()] * (len(rows) - before)
                size += len(text)
                if size > TOGETHER and rows:
                    yield piece(ids, rows)
                    ids, rows, size = [], [], 0
            if rows:
                yield piece(ids, rows)

    kind = StructType.fromDDL(f"doc_id long, {schema}")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), column).mapInArrow(run, kind)


@F.arrow_udf(ArrayType(TEXT))
def first_grams(texts: pa.Array) -> pa.Array:
    """The distinct one to three characters that stand together in each text."""
    pieces, held, size = [], [], 0
    for x in texts:
        t = x.as_py()
        held.append(None if t is None else [*{*t, *map("".join, zip(t, t[1:])), *map("".join, zip(t, t[1:], t[2:]))}])
        size += len(t or "")
        if size > TOGETHER:
            pieces.append(pa.array(held, pa.list_(pa.string())))
            held, size = [], 0
    return pa.concat_arrays([*pieces, pa.array(held, pa.list_(pa.string()))])


DIFF = StructType([StructField(n, IntegerType()) for n in ("raw", "corrected", "substitutions", "insertions", "deletions", "unchanged")])


def diff_counts(raw: str, corrected: str) -> dict:
    """Characters of two texts that are the same, put for others, put in and taken out: of
    what is between two matching blocks as much counts as replaced as both sides have."""
    ops = np.array([(i1 - i0, j1 - j0) for kind, i0, i1, j0, j1 in matching.operations(raw, corrected, matching.matching(raw, corrected)) if kind != "equal"], np.int64).reshape(-1, 2)
    both = ops.min(axis=1)
    taken, put = (ops.sum(axis=0) - both.sum()).tolist()
    same = len(raw) - int(ops[:, 0].sum())
    return {"raw": len(raw), "corrected": len(corrected), "substitutions": int(both.sum()), "insertions": put, "deletions": taken, "unchanged": same}


def diff_counts_many(raw: Sequence[str], corrected: Sequence[str]) -> np.ndarray:
    """``diff_counts`` of many pairs of texts, a row each."""
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (raw, corrected))
    out = np.stack((la, lb, *[np.zeros_like(la)] * 4), axis=1)
    for begun, found in matching.matching_many(raw, corrected):
        text = found[:, 0] + begun
        new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else text
        before = []
        for k in (1, 2):  # what lies between each block and the one before it
            ends = found[:, k] + found[:, 3]
            gap = found[:, k] - np.concatenate(([0], ends[:-1]))
            gap[new] = found[new, k]
            before.append(gap)
        np.add.at(out[:, 2], text, np.minimum(*before))
        np.add.at(out[:, 5], text, found[:, 3])
        last = np.append(new[1:], len(text)) - 1 if len(text) else text
        rest = np.stack((la, lb))[:, text[last]] - found[last, 1:3].T - found[last, 3]
        np.add.at(out[:, 2], text[last], rest.min(axis=0))
    # a text of which nothing was found is replaced by the other
    out[:, 2] += np.where(out[:, 5] == 0, np.minimum(la, lb), 0)
    out[:, 3], out[:, 4] = lb - out[:, 5] - out[:, 2], la - out[:, 5] - out[:, 2]
    return out


@F.pandas_udf(DIFF)
def diff_summary(raw: pd.Series, corrected: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(diff_counts_many(raw.fillna("").tolist(), corrected.fillna("").tolist()), columns=DIFF.names)


@F.pandas_udf(TEXT)
def unified_diff(raw: pd.Series, corrected: pd.Series) -> pd.Series:
    lines = lambda t: (t or "").splitlines(keepends=True)
    return pd.Series(["".join(difflib.unified_diff(lines(a), lines(b), "a/text.raw.txt", "b/text.corrected.txt", n=2)) for a, b in zip(raw, corrected, strict=True)], dtype=object)


@F.arrow_udf(IntegerType())
def edit_distance(old: pa.Array, new: pa.Array) -> pa.Array:
    return pa.array(distance.distances(old.to_pylist(), new.to_pylist()), pa.int32())


def placeholder(n: int) -> str:
    """The n-th name, from 0: all of one letter, then all of two, and so on."""
    letters = 1
    while n >= 26**letters:
        n -= 26**letters
        letters += 1
    digits = (n // 26**k % 26 for k in reversed(range(letters)))
    return f"__PHASE_TOKEN_{''.join(map(ascii_uppercase.__getitem__, digits))}__"


def protect(text: str, terms: list[tuple[str, str, bool]]) -> tuple[str, dict[str, str]]:
    """Every occurrence of a term (what is written, what it stands for, whether case
    counts) replaced by a placeholder of its own, longer terms first; and what each
    placeholder stands for."""
    held: dict[str, str] = {}
    pieces = [text]  # what is still open at even places, placeholders between
    for term, meant, exact in sorted({t for t in terms if t[0]}, key=lambda t: (-len(t[0]), t)):
        find = re.compile(f"({re.escape(term)})", 0 if exact else re.I)
        out: list[str] = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(piece)
                continue
            for k, part in enumerate(find.split(piece)):
                if k % 2:
                    part = placeholder(len(held))
                    held[part] = meant
                out.append(part)
        pieces = out
    return "".join(pieces), held


_EXACT = re.compile(r"(__PHASE_TOKEN_[A-Z]+__)")
# of the underscores between two placeholders the second keeps some
_LOOSE = re.compile(r"_+\s*(PHASE_TOKEN_[A-Z]+)\s*_+?(?=_+\s*PHASE_TOKEN_|[^_]|\Z)", re.I)


def restore(text: str, held: dict[str, str]) -> tuple[str, list[str]]:
    """Placeholders back to terms, and those that are missing.

    A placeholder is taken as it was written.  Only one that isn't there is looked
    for with its case changed, or with blanks or other numbers of underscores at its
    ends.  Nothing outside the underscores is touched, and no term is searched.
    """
    pieces = _EXACT.split(text)
    missing = set(held).difference(pieces[1::2])
    found: set[str] = set()

    def loose(m: re.Match) -> str:
        name = f"__{m[1].upper()}__"
        if name not in missing:
            return m[0]
        found.add(name)
        return held[name]

    pieces[1::2] = [held.get(name, name) for name in pieces[1::2]]
    if missing:
        pieces[::2] = [_LOOSE.sub(loose, literal) for literal in pieces[::2]]
    return "".join(pieces), sorted(missing - found)


@F.pandas_udf(StructType([StructField("text", TEXT), StructField("held", MapType(TEXT, TEXT))]))
def protect_tokens(text: pd.Series, terms: pd.Series) -> pd.DataFrame:
    got = [protect(t or "", [(y["term"], y["meant"], bool(y["exact"])) for y in x] if x is not None else []) for t, x in zip(text, terms, strict=True)]
    return pd.DataFrame({"text": [g[0] for g in got], "held": [g[1] for g in got]})


@F.pandas_udf(StructType([StructField("text", TEXT), StructField("missing", ArrayType(TEXT))]))
def restore_tokens(text: pd.Series, held: pd.Series) -> pd.DataFrame:
    got = [restore(t or "", dict(h or {})) for t, h in zip(text, held, strict=True)]
    return pd.DataFrame({"text": [g[0] for g in got], "missing": [g[1] for g in got]})
