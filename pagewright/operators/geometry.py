"""Boxes, affine transforms, containment joins and one-dimensional clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rect(*quad: Column) -> Column:
    """struct(x0, y0, x1, y1) around x1, y1, ... x4, y4."""
    x, y = quad[0::2], quad[1::2]
    return F.struct(F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"))


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def intersects(a: Column, b: Column) -> Column:
    """Sharing more than an edge."""
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def iou(a: Column, b: Column) -> Column:
    both = (F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * (F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return F.when(intersects(a, b), both / (area(a) + area(b) - both)).otherwise(0.0)


def scaled(r: Column, factor: float) -> Column:
    return F.struct(*(F.bround(r[c] * factor, 2).alias(c) for c in ("x0", "y0", "x1", "y1")))


def rotation(angle: Column, cx: Column, cy: Column) -> Column:
    """The affine transform (a, b, tx, c, d, ty) that turns by degrees about a point."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.struct(c.alias("a"), (-s).alias("b"), (cx - c * cx + s * cy).alias("tx"), s.alias("c"), c.alias("d"), (cy - s * cx - c * cy).alias("ty"))


def applied(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["b"] * y + m["tx"]).alias("x"), (m["c"] * x + m["d"] * y + m["ty"]).alias("y"))


def inverse(m: Column) -> Column:
    """Null where the transform has none."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    a, b, c, d = m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det
    return F.when(F.abs(det) >= 1e-12, F.struct(a.alias("a"), b.alias("b"), (-(a * m["tx"] + b * m["ty"])).alias("tx"), c.alias("c"), d.alias("d"), (-(c * m["tx"] + d * m["ty"])).alias("ty")))


def lines_in_cells(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """page_id, cell_id, text, confidence: lines whose centre is in a cell, edges included."""
    c, l = cells.alias("c"), lines.alias("l")
    x, y = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    hit = (F.col("c.page_id") == F.col("l.page_id")) & x.between(F.col("c.x0"), F.col("c.x1")) & y.between(F.col("c.y0"), F.col("c.y1"))
    got = c.join(l, hit, "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("l.text").isNotNull(), F.struct("l.line_index", "l.text")))), lambda v: v["text"]), "\n")
    return got.groupBy(F.col("c.page_id").alias("page_id"), F.col("c.cell_id").alias("cell_id")).agg(joined.alias("text"), F.bround(F.avg("l.confidence"), 4).alias("confidence"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose centre is in no table; blocks without a box stay."""
    b, t = blocks.alias("b"), tables.alias("t")
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = (F.col("b.page_id") == F.col("t.page_id")) & x.between(F.col("t.x0"), F.col("t.x1")) & y.between(F.col("t.y0"), F.col("t.y1"))
    return b.join(t, inside, "left_anti")


def nearest_boundary(points: DataFrame, boundaries: DataFrame, key: str, value: str) -> DataFrame:
    """points with nearest: the index of the closest boundary of their key, the first of equals."""
    near = points.join(boundaries.select(key, F.col("idx").alias("_i"), F.col("at").alias("_at")), key)
    return near.groupBy(*points.columns).agg(F.min_by("_i", F.struct(F.abs(F.col(value) - F.col("_at")), "_i")).alias("nearest"))


def line_clusters(values: DataFrame, key: str, value: str, gap: float = 4.0) -> DataFrame:
    """key, cluster, centre: sorted values start a cluster where they leave a gap."""
    order = Window.partitionBy(key).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("int"), F.lit(0))
    rows = values.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "cluster").agg(F.bround(F.avg(value)).cast("long").alias("centre"))


def mean_clusters(values: DataFrame, key: str, value: str, tolerance: float = 1.0) -> DataFrame:
    """key, cluster (from 0), mean, n: sorted values join a cluster while within
    ``tolerance`` of its running mean.

    The mean never passes the last value, so a gap above the tolerance always ends a
    cluster: values are cut into islands there, and only islands are folded.
    """
    order = Window.partitionBy(key).orderBy(value)
    gap = F.coalesce((F.col(value) - F.lag(value).over(order) > tolerance).cast("int"), F.lit(0))
    islands = values.where(F.col(value).isNotNull()).withColumn("_gap", gap).withColumn("_island", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    state = "struct<done:array<struct<total:double,n:int>>,total:double,n:int>"

    def step(acc: Column, v: Column) -> Column:
        joins = (acc["n"] == 0) | (v - acc["total"] / acc["n"] <= tolerance)
        closed = F.array_append(acc["done"], F.struct(acc["total"].alias("total"), acc["n"].alias("n")))
        grown = F.struct(acc["done"].alias("done"), (acc["total"] + v).alias("total"), (acc["n"] + 1).alias("n"))
        return F.when(joins, grown).otherwise(F.struct(closed.alias("done"), v.alias("total"), F.lit(1).alias("n")))

    zero = F.struct(F.array().cast("array<struct<total:double,n:int>>").alias("done"), F.lit(0.0).alias("total"), F.lit(0).alias("n")).cast(state)
    folded = F.aggregate(F.array_sort(F.collect_list(F.col(value).cast("double"))), zero, step, lambda acc: F.array_append(acc["done"], F.struct(acc["total"].alias("total"), acc["n"].alias("n"))))
    found = islands.groupBy(key, "_island").agg(folded.alias("_c")).select(key, "_island", F.posexplode("_c").alias("_i", "_c"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_island", "_i")) - 1
    return found.select(key, nth.alias("cluster"), (F.col("_c.total") / F.col("_c.n")).alias("mean"), F.col("_c.n").alias("n"))


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """page_id, line, first, last: the runs of neighbouring dark pixels(page_id, y, x) of a row."""
    own = Window.partitionBy("page_id", "y").orderBy("x")
    rows = pixels.withColumn("_new", F.coalesce((F.col("x") - F.lag("x").over(own) > 1).cast("int"), F.lit(0)))
    return rows.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("page_id", F.col("y").alias("line"), "_run").agg(F.min("x").alias("first"), F.max("x").alias("last")).drop("_run")


def longest_runs(runs: DataFrame, gap: int = 2) -> DataFrame:
    """page_id, line, longest of runs(page_id, line, first, last): the longest once gaps
    of up to ``gap`` pixels are bridged."""
    own = Window.partitionBy("page_id", "line").orderBy("first")
    rows = runs.withColumn("_new", F.coalesce((F.col("first") - F.lag("last").over(own) > gap + 1).cast("int"), F.lit(0)))
    joined = rows.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("page_id", "line", "_run").agg((F.max("last") - F.min("first") + 1).alias("n"))
    return joined.groupBy("page_id", "line").agg(F.max("n").alias("longest"))


def dark_runs(pixels: DataFrame, gap: int = 2) -> DataFrame:
    """page_id, y, longest: the longest run of dark pixels of a row, bridging gaps of up to ``gap``."""
    return longest_runs(pixel_runs(pixels.where("dark")), gap).withColumnRenamed("line", "y")
