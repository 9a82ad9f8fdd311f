"""Work along an order that is spread over range partitions, with what is open or summed carried over their edges.

A table is dealt into ranges of its order once and written with the number of each row's range. Inside a
range, windows or a sweep over sorted rows see only rows of that range; across ranges only one row for each (range,
group), or the intervals that are still open at a range's end, are carried. No group, such as a chromosome, has to
fit into one task, and intervals may be longer than any range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.plans.tables import keep_table

PART = "_part"


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order``, written, with the number of each row's range in ``_part``."""
    return keep_table(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def earlier(df: DataFrame, by: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """A dealt table with a column for each of ``values``: max, min, sum, count or last (known) of an expression over all
    earlier rows of the same ``by``. The order has no ties, and begins with ``by``; without earlier rows a sum or count is 0, others null."""
    how = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
    both = {"max": F.greatest, "min": F.least, "last": F.coalesce}
    here = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    whole, carry, local = [], [], []
    for name, (kind, value) in values.items():
        whole.append((F.max_by(value, F.when(value.isNotNull(), place)) if kind == "last" else how[kind](value)).alias(f"_t_{name}"))
        carry.append(how["sum" if kind == "count" else kind](F.col(f"_t_{name}")).over(before).alias(f"_t_{name}"))
        local.append(how[kind](value).over(here).alias(name))
    totals = df.groupBy(PART, *by).agg(*whole).select(F.col(PART).alias("_q"), *[F.col(c).alias(f"_by_{c}") for c in by], *carry)
    rows = df.select("*", *local)
    same = rows[PART] == totals["_q"]
    for c in by:
        same = same & rows[c].eqNullSafe(totals[f"_by_{c}"])
    joined = rows.join(totals, same, "left")
    out = []
    for name, (kind, _) in values.items():
        if kind in ("sum", "count"):
            out.append((F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_t_{name}"), F.lit(0))).alias(name))
        else:
            out.append(both[kind](F.col(name), F.col(f"_t_{name}")).alias(name))
    return joined.select(*[c for c in df.columns if c not in values], *out)


def covering(points: DataFrame, intervals: DataFrame, priority: str, take: list[str], name: str = "hit") -> DataFrame:
    """``points`` (``chr, pos, ...``) with the struct ``name`` of the columns ``take`` of one interval (``chr, start, end, ...``, both
    ends inside) that holds each: the one of highest ``priority`` (a number; ties go to the later start, then the later end, then to what
    their columns hold); null where none does.

    Points and starts of intervals are swept in order. An interval that a later-ending one of higher priority covers at a range's end
    is not carried on, so what is carried are the intervals that can still decide. Intervals without a start, end or priority,
    and those that end before they start, hold no point; points without a position get null.
    """
    own = points.columns
    packed = F.to_json(F.struct(*take), {"ignoreNullFields": "false"})
    kind = intervals.select(*take).schema.simpleString()
    none = F.lit(None)
    marks = intervals.where((F.col("end") >= F.col("start")) & F.col(priority).isNotNull() & F.col("chr").isNotNull()).select(
        "chr", F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("end").cast("long").alias("end"), F.col(priority).cast("double").alias("first"), packed.alias("load"),
    )
    asked = points.select("chr", F.col("pos").cast("long").alias("at"), F.lit(1).alias("kind"), none.cast("long").alias("end"), none.cast("double").alias("first"), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("load"))
    order = ["chr", "at", "kind", "end", "first", "load"]
    marks = dealt(marks.unionByName(asked), *order)
    edges = marks.where(F.col("chr").isNotNull() & F.col("at").isNotNull()).groupBy(PART).agg(F.min(F.struct("chr", "at")).alias("low")).orderBy(PART)
    edges = [(r[PART], r["low"]["chr"], r["low"]["at"]) for r in edges.collect()]  # a row for each range
    shared = points.sparkSession.sparkContext.broadcast(edges)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What is open at the end of each range, once for every later range that begins inside it."""
        edges = shared.value
        starts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for chrom in {c for _, c, _ in edges}:
            mine = [(p, a) for p, c, a in edges if c == chrom]
            starts[chrom] = np.array([p for p, _ in mine]), np.array([a for _, a in mine])
        open_: dict[tuple, list] = {}  # (range, chr): keys of intervals that can still decide
        for batch in batches:
            for part, chrom, at, end, first, load in zip(batch[PART], batch["chr"], batch["at"], batch["end"], batch["first"], batch["load"], strict=True):
                parts, lows = starts.get(chrom, ((), ()))
                after = np.searchsorted(parts, part, "right")
                if after == len(parts) or end < lows[after]:
                    continue  # it ends before the next range
                held, new = open_.setdefault((part, chrom), []), (first, at, end, load)
                if not any(x >= new and x[2] >= end for x in held):
                    held[:] = [x for x in held if x > new or x[2] > end] + [new]
        rows = []
        for (part, chrom), held in open_.items():
            parts, lows = starts[chrom]
            for first, at, end, load in held:
                a, b = np.searchsorted(parts, part, "right"), np.searchsorted(lows, end, "right")
                rows += [(int(p), chrom, int(at), -1, int(end), first, load) for p in parts[a:b]]
        if rows:
            yield pd.DataFrame(rows, columns=[PART, *order])

    schema = f"{PART} int, chr string, at long, kind int, end long, first double, load string"
    columns = [PART, *order]
    marks = marks.select(*columns)
    # the ends of a range that is read by several tasks carry an interval too many at most, which changes nothing
    carried = marks.where("kind = 0").mapInPandas(tails, schema)
    low = F.when(F.col("kind") < 0, F.lit(-(1 << 62))).otherwise(F.col("at"))
    rows = marks.unionByName(carried.select(*columns)).withColumn("_low", low).repartition(PART).sortWithinPartitions(PART, "chr", "_low", "kind", "end", "first", "load")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, open_ = None, []
        for batch in batches:
            out, hits = [], []
            for part, chrom, at, kind_, end, first, load in zip(batch[PART], batch["chr"], batch["at"], batch["kind"], batch["end"], batch["first"], batch["load"], strict=True):
                if (part, chrom) != place:
                    place, open_ = (part, chrom), []
                if kind_ < 1:
                    heapq.heappush(open_, _Open(first, at, end, load))
                    continue
                while open_ and open_[0].end < at:
                    heapq.heappop(open_)
                out.append(load)
                hits.append(open_[0].load if open_ and at == at and chrom is not None else None)
            if out:
                yield pd.DataFrame({"load": out, "hit": hits}, dtype=object)

    found = rows.mapInPandas(sweep, "load string, hit string")
    back = found.select(F.from_json("load", points.schema).alias("p"), F.from_json("hit", kind).alias(name))
    return back.select(*[F.col("p")[c].alias(c) for c in own], name)


class _Open:
    """An open interval; the first of a heap is the one that decides."""

    __slots__ = ("key", "end", "load")

    def __init__(self, first: float, at: int, end: int, load: str) -> None:
        self.key, self.end, self.load = (first, at, end, load), end, load

    def __lt__(self, other: "_Open") -> bool:
        return self.key > other.key
