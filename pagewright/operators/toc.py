"""Tables of contents: validation and re-linking after the text has changed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window


def toc_errors(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """entries(doc_id, entry_id, label, level, parent_id, target_id, ord) with errors."""
    doc = ("doc_id",)
    parent = entries.select("doc_id", F.col("entry_id").alias("parent_id"), F.col("level").alias("_pl"), F.col("ord").alias("_po")).dropDuplicates(["doc_id", "parent_id"])
    known = targets.select("doc_id", "target_id", F.lit(True).alias("_known")).distinct()
    rows = entries.join(parent, ["doc_id", "parent_id"], "left").join(known, ["doc_id", "target_id"], "left")
    twice = lambda c: F.count("*").over(Window.partitionBy(*doc, c)) > 1
    rules = (
        (~F.col("entry_id").rlike(r"^[A-Za-z][A-Za-z0-9_.:-]*$"), "id"),
        (twice("entry_id"), "duplicate_id"),
        ((F.length(F.trim("label")) < 1) | (F.length("label") > 300), "label"),
        (~F.col("level").between(1, 3), "level"),
        ((F.col("level") > 1) & F.col("_pl").isNull(), "parent_missing"),
        ((F.col("level") == 1) & F.col("parent_id").isNotNull(), "parent_unexpected"),
        (F.col("_pl").isNotNull() & (F.col("_pl") != F.col("level") - 1), "parent_level"),
        (F.col("_po") >= F.col("ord"), "parent_order"),
        (F.col("_known").isNull(), "target_missing"),
        (F.col("target_id").isNotNull() & twice("target_id"), "duplicate_target"),
    )
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules)))).drop("_pl", "_po", "_known")


def claims(own: list[dict], there: list[dict]) -> list[tuple]:
    """(entry_id, target_id, state) of a document's entries, each list by ord.  What is
    unclaimed of a key is kept as a number of places and their sum, which is the place
    where only one is left."""
    ids = {t["target_id"] for t in there}
    places: dict[str, list[int]] = {}
    number: dict[str, int] = {}
    total: dict[str, int] = {}
    for i, t in enumerate(there):
        if t["match_key"] is not None:
            places.setdefault(t["target_id"], []).append(i)
            number[t["match_key"]] = number.get(t["match_key"], 0) + 1
            total[t["match_key"]] = total.get(t["match_key"], 0) + i

    def use(target: str | None) -> None:
        for i in places.pop(target, ()):
            number[there[i]["match_key"]] -= 1
            total[there[i]["match_key"]] -= i

    for e in own:
        if e["target_id"] in ids:
            use(e["target_id"])
    out = []
    for e in own:
        if e["target_id"] in ids:
            out.append((e["entry_id"], e["target_id"], "ok"))
            continue
        free = number.get(e["match_key"], 0)
        target = there[total[e["match_key"]]]["target_id"] if free == 1 else None
        if free == 1:
            use(target)
        out.append((e["entry_id"], target, "rematched" if free == 1 else "ambiguous" if free else "missing"))
    return out


_CLAIM = StructType([StructField(n, StringType()) for n in ("entry_id", "target_id", "state")])


@F.arrow_udf(ArrayType(_CLAIM))
def _claims(own: pa.Array, there: pa.Array) -> pa.Array:
    names = _CLAIM.fieldNames()
    out = [[dict(zip(names, c, strict=True)) for c in claims(x.as_py(), y.as_py() or [])] for x, y in zip(own, there, strict=True)]
    return pa.array(out, to_arrow_type(ArrayType(_CLAIM)))


def relinked(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, entry_id, target_id, state: by id, else by match key where just one
    target of that key is unclaimed; claims are made in the entries' order."""
    listed = lambda df, name, *columns: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias(name))
    both = listed(entries, "own", "entry_id", "target_id", "match_key").join(listed(targets, "there", "target_id", "match_key"), "doc_id", "left")
    got = both.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_claims("own", "there")).alias("c"))
    return got.select("doc_id", "c.entry_id", "c.target_id", "c.state")


def toc_saved(states: DataFrame, requests: DataFrame, invalid: DataFrame) -> DataFrame:
    """doc_id, outcome of requests(doc_id, base_source, base_toc, base_preview,
    regenerate, confirmed) to save a table of contents or to make it anew: that needs
    to be confirmed, all three revisions (states: source, toc, preview) must be those
    that the request was made for, and documents in invalid(doc_id) have bad entries."""
    got = requests.join(states.withColumn("_known", F.lit(True)), "doc_id", "left").join(invalid.select("doc_id", F.lit(True).alias("_bad")).distinct(), "doc_id", "left")
    rules = (
        (F.col("_known").isNull(), "not_found"),
        (F.col("regenerate") & ~F.col("confirmed"), "confirmation_required"),
        *((~F.col(f"base_{p}").eqNullSafe(F.col(p)), f"{p}_changed") for p in ("source", "toc", "preview")),
        (F.col("_bad").isNotNull(), "invalid"),
    )
    return got.select("doc_id", F.coalesce(*(F.when(c, F.lit(n)) for c, n in rules), F.lit("saved")).alias("outcome"))
