"""Exact quantiles of many columns, and places in a global order, without a task that holds a whole column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import known

#: Ranges into which a column's interval is cut in each pass, and values that are few enough to be fetched.
RANGES, FEW = 1024, 256


def quantiles(df: DataFrame, columns: list[str], share: float = 0.5) -> dict[str, float | None]:
    """The exact quantile of each column, interpolated between its two neighbours; None for a column without a finite value.

    Rank selection: values are counted in RANGES equal ranges between a column's least and greatest value;
    the range in which the sought rank falls is cut again, until it holds one value or FEW. A pass serves
    all columns at once, is folded map-side, and sends one row for each column and range to the driver, at
    most. Ranges start anew at the values found in them, so far outliers cost one pass.
    """
    if not columns:
        return {}
    every = F.array(*(F.struct(F.lit(i).alias("c"), known(F.col(f).cast("double")).alias("v")) for i, f in enumerate(columns)))
    values = df.select(F.explode(every).alias("e")).select("e.c", "e.v").where("v IS NOT NULL")
    out: dict[str, float | None] = dict.fromkeys(columns)
    open_: dict[int, tuple[float, float, int, int]] = {}  # least, greatest, the two ranks sought within
    part: dict[int, float] = {}
    for r in values.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        at = (r["n"] - 1) * share
        open_[r["c"]], part[r["c"]] = (r["low"], r["high"], math.floor(at), math.ceil(at)), at - math.floor(at)
    while open_:
        for c, (low, high, _, _) in list(open_.items()):
            if low == high:
                out[columns[c]] = low
                del open_[c]
        if not open_:
            break
        least, most = (F.element_at(F.create_map(*(F.lit(x) for c, o in open_.items() for x in (c, float(o[k])))), F.col("c")) for k in (0, 1))
        inside = values.where(F.col("c").isin(list(open_))).withColumns({"a": least, "b": most}).where("v BETWEEN a AND b")
        place = F.floor((F.col("v") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2) * RANGES)
        ranged = inside.groupBy("c", F.least(place, F.lit(RANGES - 1)).cast("int").alias("k"))
        rows = ranged.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        few: dict[int, tuple[float, float, int, int]] = {}
        for c, (_, _, first, second) in list(open_.items()):
            own = sorted((r for r in rows if r["c"] == c), key=lambda r: r["k"])
            before = 0
            for r, after in zip(own, [*own[1:], None], strict=True):
                if first < before + r["n"]:
                    if second >= before + r["n"]:  # the last of this range and the first of the next
                        out[columns[c]] = r["high"] + (after["low"] - r["high"]) * part[c]
                        del open_[c]
                    else:
                        open_[c] = (r["low"], r["high"], first - before, second - before)
                        if r["n"] <= FEW:
                            few[c] = open_.pop(c)
                    break
                before += r["n"]
        if few:
            wanted = F.lit(False)
            for c, (low, high, _, _) in few.items():
                wanted = wanted | ((F.col("c") == c) & F.col("v").between(low, high))
            found: dict[int, list[float]] = {c: [] for c in few}
            for r in values.where(wanted).collect():
                found[r["c"]].append(r["v"])
            for c, (_, _, first, second) in few.items():
                own = sorted(found[c])
                out[columns[c]] = own[first] + (own[second] - own[first]) * part[c]
    return out


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 0: places within ranges of the order, with offsets added over the ranges; no task orders all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: adaptive execution leaves the ranges as they are
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))  # one row for each range
    placed = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    return placed.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
