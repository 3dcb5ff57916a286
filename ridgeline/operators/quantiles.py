"""Exact percentiles without a buffer that grows with the rows.

The values of ranks floor(p (n - 1)) and ceil(p (n - 1)) are selected by histogram: each round counts the
values between a rank's bounds in BINS ranges, finds the range that holds the rank, and goes on with the least
and the largest value in it. Counts combine before their shuffle, so a round moves at most BINS rows
for each task and open interval. When at most FEW values lie between the bounds, they are sorted in one array.
Ranges are even in the value and, every other round, in its logarithm, so that far-out values cannot make
many rounds.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.tables import stage

BINS = 1024
FEW = 4096
MAX_ROUNDS = 200


def _range(value: Column, lo: Column, hi: Column, logarithmic: bool) -> Column:
    even = (value / 2 - lo / 2) / (hi / 2 - lo / 2)
    if logarithmic:
        scale = lambda v: F.signum(v) * F.log1p(F.abs(v))
        even = F.when(scale(hi) > scale(lo), (scale(value) - scale(lo)) / (scale(hi) - scale(lo))).otherwise(even)
    return F.least(F.floor(even * BINS), F.lit(BINS - 1)).cast("int")


def _between(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(spans, keys).where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))


def quantiles(values: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys, n, q): for each key of `values(keys, value)` the number of values and the array of percentiles
    `probs` (0 to 1), interpolated between neighbours. Null and NaN values are left out, and so are keys without
    others; values are finite. Without keys, one row. Writes its stages when called."""
    if not keys:
        return quantiles(values.withColumn("all_rows", F.lit(0)), ["all_rows"], probs).drop("all_rows")
    rows = values.select(*keys, F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)")
    rows = stage(rows, "quantile-values")
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = {p: F.lit(float(p)) * (F.col("n") - 1) for p in probs}
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)]))
    state = stage(whole.select(*keys, "n", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), "lo", "hi"), "quantile-ranks")
    is_open = (F.col("lo") < F.col("hi")) & (F.col("held") > FEW)
    for k in range(MAX_ROUNDS):
        wide = state.where(is_open)
        if not wide.take(1):
            break
        cell = _range(F.col("value"), F.col("lo"), F.col("hi"), k % 2 == 1).alias("cell")
        cells = _between(rows, wide.select(*keys, "lo", "hi").distinct(), keys).groupBy(*keys, "lo", cell).agg(
            F.count(F.lit(1)).alias("c_n"), F.min("value").alias("c_lo"), F.max("value").alias("c_hi"))
        upto = F.sum("c_n").over(Window.partitionBy(*keys, "lo").orderBy("cell"))  # at most BINS rows
        found = wide.drop("hi", "held").join(cells.withColumn("upto", upto), [*keys, "lo"])
        start = F.col("below") + F.col("upto") - F.col("c_n")
        found = found.where((F.col("rank") >= start) & (F.col("rank") < start + F.col("c_n")))
        moved = found.select(*keys, "n", "rank", start.alias("below"), F.col("c_n").alias("held"), F.col("c_lo").alias("lo"), F.col("c_hi").alias("hi"))
        state = stage(moved.unionByName(state.where(~is_open)), "quantile-ranks")
    else:
        raise RuntimeError("percentiles did not settle")
    spans = state.where("lo < hi").select(*keys, "lo", "hi").distinct()
    sorted_ = _between(rows, spans, keys).groupBy(*keys, "lo").agg(F.array_sort(F.collect_list("value")).alias("own"))  # at most FEW
    exact = state.join(sorted_, [*keys, "lo"], "left")
    at = F.coalesce(F.try_element_at("own", (F.col("rank") - F.col("below") + 1).cast("int")), F.col("lo"))
    by_rank = exact.select(*keys, "n", F.struct("rank", at.alias("value")).alias("x")).groupBy(*keys).agg(
        F.first("n").alias("n"), F.map_from_entries(F.collect_list("x")).alias("at"))  # two ranks for each of `probs`

    def lerp(x: Column) -> Column:
        low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
        return F.when(low == high, F.element_at("at", low)).otherwise((high - x) * F.element_at("at", low) + (x - low) * F.element_at("at", high))

    return by_rank.select(*keys, "n", F.array(*[lerp(x) for x in place.values()]).alias("q"))


def long_form(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, name, value): a row for each of `columns`."""
    return rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))


def wide_form(found: DataFrame, keys: list[str], named: dict[str, tuple[str, int]]) -> DataFrame:
    """One row for each of `keys` from percentiles by (keys, name): columns named[c] = (name, number of the percentile)."""
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("q")[k])).alias(c) for c, (name, k) in named.items()])
