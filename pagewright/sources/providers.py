"""Pluggable recognisers and translators as table functions, with offline stand-ins.

A provider maps Arrow batches; nothing in it is asked for a row at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "id string, translated string, status string, error string"


class Translator(Protocol):
    name: str
    cloud: bool

    def translate(self, texts: pd.Series) -> pd.Series: ...


class Identity:
    name, cloud = "identity", False

    def translate(self, texts: pd.Series) -> pd.Series:
        return texts


class Dictionary:
    """Word for word, unknown words kept."""

    name, cloud = "dictionary", False

    def __init__(self, words: dict[str, str]):
        self.words = words

    def translate(self, texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(self.words.get(w, w) for w in t.split(" ")))


class Reply(NamedTuple):
    """What a provider may give for a text instead of a string: a truncated one is no success."""

    text: str
    truncated: bool = False


class Outcome(NamedTuple):
    """translated has a content, truncated what there is of it, failed and cancelled none."""

    status: str
    content: str | None
    error: str | None


#: Seconds before each further try.
WAITS = (0.25, 1.0, 2.0)
#: Failed calls without any success between them after which a provider is given up.
PATIENCE = 40


def tried(call: Callable, value, tries: int = 3, sleep: Callable = time.sleep, cancelled: Callable[[], bool] = lambda: False) -> tuple:
    """What ``call`` makes of ``value``, or null, and the error: only a timeout is worth
    another try, after a wait, and a cancelled task makes none."""
    error = None
    for n in range(tries):
        if cancelled():
            return None, "cancelled"
        try:
            return call(value), None
        except TimeoutError as e:
            error = str(e) or "timeout"
            if n + 1 < tries:
                sleep(WAITS[min(n, len(WAITS) - 1)])
        except Exception as e:  # a provider may raise anything; the rows tell
            return None, str(e) or type(e).__name__
    return None, error


def _replies(provider: Translator, texts: pd.Series) -> list[Reply]:
    found = list(provider.translate(texts.reset_index(drop=True)))
    if len(found) != len(texts) or not all(isinstance(x, str | Reply) for x in found):
        raise ValueError("invalid_response")
    return [x if isinstance(x, Reply) else Reply(x) for x in found]


def outcomes(provider: Translator, texts: pd.Series, tries: int = 3, sleep: Callable = time.sleep, cancelled: Callable[[], bool] = lambda: False) -> list[Outcome]:
    """An outcome for each text.  A batch that fails is halved until what fails stands
    alone, so one bad text costs about two calls for each halving, not the batch.  A
    provider that only fails is given up after PATIENCE calls."""
    out: list[Outcome | None] = [None] * len(texts)
    todo, failed, last = [(0, len(texts))] if len(texts) else [], 0, None
    while todo:
        a, b = todo.pop()
        if failed >= PATIENCE or last == "cancelled":
            got, error = None, last
        else:
            got, error = tried(lambda t: _replies(provider, t), texts.iloc[a:b], tries, sleep, cancelled)
        if got is not None:
            failed = 0
            out[a:b] = [Outcome("truncated", r.text, "truncated") if r.truncated else Outcome("translated", r.text, None) for r in got]
        elif b - a == 1 or failed >= PATIENCE or error == "cancelled":
            out[a:b] = [Outcome("cancelled" if error == "cancelled" else "failed", None, error)] * (b - a)
            failed, last = failed + 1, error
        else:
            middle = (a + b) // 2
            todo += [(middle, b), (a, middle)]
            failed, last = failed + 1, error
    return out


def _allowed(consent: bool, *providers: Translator) -> None:
    if not consent and any(p.cloud for p in providers):
        raise PermissionError("a cloud provider needs consent")


def _rows(ids: pd.Series, found: list[Outcome]) -> pd.DataFrame:
    return pd.DataFrame({"id": ids.to_numpy(), "translated": [o.content for o in found], "status": [o.status for o in found], "error": [o.error for o in found]}, dtype=object)


def translated(segments: DataFrame, provider: Translator, consent: bool = False, tries: int = 3) -> DataFrame:
    """id, translated, status, error of segments(id, text); a cloud provider needs consent."""
    _allowed(consent, provider)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _rows(b["id"], outcomes(provider, b["text"], tries))

    return segments.select("id", "text").mapInPandas(run, ANSWER)


def hybrid(segments: DataFrame, first: Translator, then: Translator, consent: bool = False, tries: int = 3) -> DataFrame:
    """A baseline and a polish over it, each asked once for a text: where the polish isn't
    a success the baseline stays, with the polish's error beside it."""
    _allowed(consent, first, then)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = outcomes(first, b["text"], tries)
            good = [i for i, o in enumerate(found) if o.status == "translated"]
            for i, o in zip(good, outcomes(then, pd.Series([found[i].content for i in good], dtype=object), tries), strict=True):
                found[i] = o if o.status == "translated" else found[i]._replace(error=o.error)
            yield _rows(b["id"], found)

    return segments.select("id", "text").mapInPandas(run, ANSWER)


def recognised(pages: DataFrame, recorded: DataFrame) -> DataFrame:
    """Replays recorded lines (page_id, line_index, text, ...) for pages(page_id, width, height); sizes out of range give an error row."""
    good = F.col("width").between(10, 10_000) & F.col("height").between(10, 10_000)
    return pages.join(recorded.where("line_index < 1000"), "page_id", "left").withColumn("error", F.when(~good, "image_size").when(F.col("line_index").isNull(), "no_text"))


def answers(rows: DataFrame, column: str, handler: Callable[[str], str | Reply], tries: int = 3) -> DataFrame:
    """A language model's replies to prompts, by a handler that stands in for it: answer
    (struct of success, status, content, error); one reply that fails leaves the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _Handler(handler)
        for b in batches:
            found = [outcomes(model, pd.Series([x], dtype=object), tries)[0] for x in b[column]]
            yield b.assign(answer=[{"success": o.status == "translated", "status": {"translated": "completed"}.get(o.status, o.status), "content": o.content, "error": o.error} for o in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}{', ' if fields else ''}answer struct<success:boolean,status:string,content:string,error:string>")


class _Handler:
    name, cloud = "handler", False

    def __init__(self, handler: Callable[[str], str | Reply]):
        self.handler = handler

    def translate(self, texts: pd.Series) -> list:
        return [self.handler(t) for t in texts]
