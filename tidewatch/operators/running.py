"""Running sums and exact quantiles over all rows in an order, in parallel.

One ordered window without groups is one task. Here values are dealt to buckets that keep their
order; each bucket sums up for itself, and starts from the total of the buckets before it. There
are few buckets whatever the rows, so the totals' own window is small. The buckets' bounds come
from the data, so that about as many distinct values fall into each, whatever their scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import materialise

BUCKETS = 128


def bounds(rows: DataFrame, value: str) -> list[float]:
    """Rising values that part the column into about ``BUCKETS`` parts; at most that many numbers reach the driver."""
    found = rows.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / BUCKETS for i in range(1, BUCKETS)], 0.25 / BUCKETS)
    return sorted(set(found))


def bucket_of(value: Column, at: list[float]) -> Column:
    """Grows with ``value``; nulls first, NaN last, as Spark sorts them."""
    v = value.cast("double")
    inner = F.size(F.filter(F.array(*map(F.lit, at)).cast("array<double>"), lambda x: x <= v))
    return F.when(v.isNull(), -1).when(F.isnan(v), len(at) + 1).otherwise(inner)


def running(rows: DataFrame, value: str, sums: dict[str, str], by: tuple[str, ...] = (), *, descending: bool = False, strict: bool = False) -> DataFrame:
    """``rows`` (one a group and value) with each of ``sums`` (name -> column) up to the row, or before it if ``strict``."""
    keys = [*by, "_bucket"]
    direction = F.desc if descending else F.asc
    rows = materialise(rows, "marks")  # read three times
    rows = rows.withColumn("_bucket", bucket_of(F.col(value), bounds(rows, value)))
    own = Window.partitionBy(*keys).orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    ahead = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_s_{n}") for n in sums])
    part = rows.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_r_{n}") for n, c in sums.items()])
    match = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = part.alias("p").join(starts.alias("s"), match)
    kept = [c for c in rows.columns if c != "_bucket"]
    return both.select(*[F.col(f"p.{c}") for c in kept], *[(F.col(f"_r_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, and for each of ``shares`` (name -> share) the exact quantile, between two values in proportion; nulls don't count.

    Counts at distinct values are dealt to buckets; the buckets' totals tell in which one each rank lies, and
    only the rows of those are put in order. A group's values are never held together. No rows give
    no row, and without groups one of nulls.
    """
    marks = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    marks = materialise(marks, "marks")
    marks = marks.withColumn("_bucket", bucket_of(F.col("_v"), bounds(marks, "_v")))
    one = Window.partitionBy(*by)
    sizes = marks.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_size"))
    upto = F.sum("_size").over(one.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = sizes.select(*by, "_bucket", (upto - F.col("_size")).alias("_start"), upto.alias("_end"), F.sum("_size").over(one).alias("_all"))
    place = lambda p: F.lit(p) * (F.col("_all") - 1)
    ranks = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(side).alias("_side"), f(place(p)).cast("long").alias("_rank")) for n, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    wanted = sizes.select("*", F.inline(ranks)).where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
    wanted = materialise(wanted, "ranks")  # two rows a group and share
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    keys = [*by, "_bucket"]
    few = marks.alias("m").join(wanted.select(*keys, "_start").distinct().alias("w"), same("m", "w", keys)).select(*[F.col(f"m.{k}") for k in keys], "_v", "_n", "_start")
    last = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = few.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))
    hit = few.alias("f").join(wanted.alias("w"), [*same("f", "w", keys), F.col("w._rank") >= F.col("f._first"), F.col("w._rank") < F.col("f._last")])
    pick = lambda n, side: F.max(F.when((F.col("_name") == n) & (F.col("_side") == side), F.col("_v")))
    got = hit.groupBy(*[F.col(f"f.{k}").alias(k) for k in by]).agg(F.max("w._all").alias("_all"), *[pick(n, s).alias(f"_{n}_{s}") for n in shares for s in ("lo", "hi")])
    part = lambda p: place(p) - F.floor(place(p))
    between = lambda n, p: F.when(part(p) == 0, F.col(f"_{n}_lo")).otherwise((1 - part(p)) * F.col(f"_{n}_lo") + part(p) * F.col(f"_{n}_hi")).alias(n)
    return got.select(*by, *[between(n, p) for n, p in shares.items()])
