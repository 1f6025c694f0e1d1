"""Daily roll-ups, standardisers, feature statistics, rankings and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch import model as M


def user_days(rows: DataFrame, features: tuple[str, ...] = M.FEATURES) -> DataFrame:
    """One row a (principal, day): counts, after-hours share, means, maxima, flag counts, label.

    One aggregation with partial sums; nothing is collected by key.
    """
    hour = F.pmod(F.atan2("hour_sin", "hour_cos") / (2 * math.pi) * 24.0, F.lit(24.0))
    hour = F.round(hour, 6)
    late = ((hour < 6.0) | (hour >= 22.0)).cast("double")
    return (
        rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        .groupBy("principal", "day")
        .agg(
            F.max("label").cast("int").alias("label"), F.count("*").alias("n_events"), F.log1p(F.count("*").cast("double")).alias("log_n_events"), F.avg(late).alias("after_hours_frac"),
            *[F.avg(f).alias(f"mean_{f}") for f in features], *[F.max(f).alias(f"max_{f}") for f in features], *[F.log1p(F.sum(f)).alias(f"log_count_{f}") for f in M.DAY_FLAGS],
        )
    )


def moments(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """feature, mean, std (population; under 1e-8 counts as 1): one pass, long form."""
    one = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in columns])
    return one.select(F.inline(pairs)).withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def standardise(rows: DataFrame, fitted_on: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with (x - mean) / std in ``columns``; the statistics are one row, joined by a constant."""
    one = fitted_on.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    both = rows.join(F.broadcast(one))  # a single row
    value = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}"))
    return both.select(*[value(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def feature_stats(rows: DataFrame, columns: tuple[str, ...], by: str) -> DataFrame:
    """by, feature, n, mean, std, min, max, zero_frac."""
    aggs = {"n": lambda c: F.count(c), "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "zero_frac": lambda c: F.avg((F.col(c) == 0).cast("double"))}
    wide = rows.groupBy(by).agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in aggs.items()])
    return wide.select(by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{k}_{c}").alias(k) for k in aggs]) for c in columns])))


def corpus_start(events: DataFrame) -> DataFrame:
    """start: the earliest time of all events; one row."""
    return events.agg(F.min(F.col("ts").cast("timestamp")).alias("start"))


def split_from_start(events: DataFrame, spans: tuple[float, float]) -> DataFrame:
    """``events`` with split, counted from the corpus' own first event."""
    own = events.join(F.broadcast(corpus_start(events).withColumnRenamed("start", "_start")))  # a single row
    return own.withColumn("split", time_split(F.col("ts"), F.col("_start"), spans)).drop("_start")


def training_days(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """User-days of benign training rows and those of malicious ones, one after the other: a day with both gives two rows."""
    return user_days(rows.where("label = 0"), features).unionByName(user_days(rows.where("label = 1"), features))


def time_split(ts: Column, start: str | Column, spans: tuple[float, float]) -> Column:
    """train before ``start`` + first span (days), val before + second, else test."""
    at = F.unix_micros(ts.cast("timestamp"))
    zero = F.unix_micros(start if isinstance(start, Column) else F.to_timestamp(F.lit(start)))
    a, b = (int(s * 86400e6) for s in (spans[0], spans[0] + spans[1]))
    return F.when(at < zero + a, "train").when(at < zero + b, "val").otherwise("test")


def routed(split: Column, label: Column) -> Column:
    """Malicious rows of the train window go to a side output."""
    return F.when((split == "train") & (label == 1), "train_malicious").otherwise(split)


def median_day_split(days: DataFrame) -> DataFrame:
    """Adds side: early before the middle distinct day, late from it on."""
    distinct = days.select("day").distinct()
    # distinct days are few whatever the rows; ranking them needs no row of the input
    ranked = distinct.select("day", F.row_number().over(Window.orderBy("day")).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    cut = ranked.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select(F.col("day").alias("_cut"))
    return days.join(F.broadcast(cut)).withColumn("side", F.when(F.col("day") < F.col("_cut"), "early").otherwise("late")).drop("_cut")


def propagate(requests: DataFrame, days: DataFrame) -> DataFrame:
    """requests (principal, day, r) with r_day (0 where the day is missing) and the larger of both."""
    both = requests.join(days.select("principal", "day", F.col("r").alias("r_day")), ["principal", "day"], "left")
    day = F.coalesce("r_day", F.lit(0.0))
    return both.withColumn("r_day", day).withColumn("r_max", F.greatest("r", "r_day"))


def insiders(events: DataFrame, top: int = 8) -> DataFrame:
    """Principals with most malicious events: count, distinct days, first, last, counts by source."""
    bad = events.where("label = 1")
    sources = bad.groupBy("principal", "source").count().groupBy("principal").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "count")))).alias("by_source"))
    main = bad.groupBy("principal").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return main.join(sources, "principal").orderBy(F.col("n").desc(), "principal").limit(top)


def scenario(events: DataFrame, principal: str, before: int = 3, after: int = 4) -> DataFrame:
    """The principal's events from some days before its first malicious day to some after its last."""
    own = events.where(F.col("principal") == principal)
    span = own.where("label = 1").agg(F.min(F.to_date("ts")).alias("_a"), F.max(F.to_date("ts")).alias("_z"))
    day = F.to_date("ts")
    return own.join(F.broadcast(span)).where((day >= F.date_sub("_a", before)) & (day < F.date_add("_z", after))).drop("_a", "_z")


def bernoulli(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows, each kept by a hash of its key: the same rows in every run."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def top_contributions(values: dict[str, Column], k: int = 3) -> Column:
    """array<struct<value,name>> of the ``k`` largest signed values, ties by name."""
    pairs = F.array(*[F.struct(v.alias("value"), F.lit(n).alias("name")) for n, v in sorted(values.items(), reverse=True)])
    return F.slice(F.sort_array(pairs, asc=False), 1, k)
