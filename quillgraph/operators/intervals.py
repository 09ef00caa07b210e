"""Points in spans by nested cells.

A span of whole numbers is cut into the fewest cells whose length is a power of
two and that start at a multiple of it: two of a size at most.  A point lies in
one cell of each size, so it meets exactly the spans that contain it, each once,
by equality of (key, size, cell); no pair outside a span is made.  Points and
spans become several rows each, which Spark's estimates don't count, so these
joins are sort-merge joins: a broadcast would bring all of them to the driver.
Where only an aggregate over the spans of a point is asked for, spans are first aggregated in
their cells, so a point meets no more rows than there are sizes, however many
spans contain it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(lo: Column, hi: Column) -> Column:
    """Array of (size, cell) that cover the whole numbers from lo to hi; size is the power of two.  Empty if either is null or lo > hi."""
    first = lambda k: -F.call_function("shiftright", -lo.cast("long"), k)  # noqa: E731 - rounded up
    end = lambda k: F.call_function("shiftright", hi.cast("long") + 1, k)  # noqa: E731 - rounded down
    odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
    sizes = F.sequence(F.lit(0), F.length(F.bin(F.greatest(hi - lo + 1, F.lit(1)).cast("long"))).cast("int"))
    left = F.transform(F.filter(sizes, lambda k: odd(first(k)) & (first(k) < end(k))), lambda k: F.struct(k.alias("size"), first(k).alias("cell")))
    rest = lambda k: first(k) + first(k).bitwiseAND(F.lit(1))
    right = F.transform(F.filter(sizes, lambda k: odd(end(k)) & (rest(k) < end(k))), lambda k: F.struct(k.alias("size"), (end(k) - 1).alias("cell")))
    return F.when(lo <= hi, F.concat(left, right)).otherwise(F.array().cast("array<struct<size:int,cell:bigint>>"))


def _cut(spans: DataFrame, lo: str, hi: str) -> DataFrame:
    return spans.select("*", F.explode(cells(F.col(lo), F.col(hi))).alias("c_")).select("*", "c_.*").drop("c_")


def _placed(points: DataFrame, at: str, cut: DataFrame) -> DataFrame:
    """Points with their cell of each size that some span has (64 sizes at most)."""
    sizes = sorted(r["size"] for r in cut.select("size").distinct().collect())
    place = lambda k: F.struct(F.lit(k).alias("size"), F.call_function("shiftright", F.col(at).cast("long"), F.lit(k)).alias("cell"))
    if not sizes:
        return points.select("*", F.lit(0).alias("size"), F.lit(0).cast("long").alias("cell")).limit(0)
    return points.select("*", F.explode(F.array(*map(place, sizes))).alias("c_")).select("*", "c_.*").drop("c_")


def spans_of_points(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """All pairs of a point and a span of the same keys that contains it, ends included; columns of both.

    Null keys, points and ends meet nothing; repeated rows pair as often as
    they stand.  Apart from the keys no column may have the same name.
    """
    cut = _cut(spans, lo, hi)
    return _placed(points, at, cut).join(cut.hint("merge"), [*keys, "size", "cell"]).drop("size", "cell")


def aggregated_over_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, parts: dict[str, Column], merge: dict[str, Callable[[str], Column]]) -> DataFrame:
    """``keys, at`` and an aggregate over the spans that contain each distinct point; points in no span are left out.

    ``parts`` aggregates spans, ``merge`` what it gives: sums of counts, least
    of least.
    """
    cut = _cut(spans, lo, hi)
    summed = cut.groupBy(*keys, "size", "cell").agg(*[c.alias(name) for name, c in parts.items()])
    distinct = points.select(*keys, at).distinct()
    return _placed(distinct, at, cut).join(summed.hint("merge"), [*keys, "size", "cell"]).groupBy(*keys, at).agg(*[merge[name](name).alias(name) for name in parts])
