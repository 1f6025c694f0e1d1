"""Threshold and rank metrics of scored rows (y 0/1, score), in exact counts at distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch import model as M
from tidewatch.functions.columns import ratio
from tidewatch.operators.running import quantiles, running


def at_threshold(rows: DataFrame, threshold: float = M.DENY, by: tuple[str, ...] = ()) -> DataFrame:
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    c = rows.groupBy(*by).agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select(*by, p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(fp, fp + tn).alias("fpr"), (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tp") + F.col("fp")).alias("predicted_positive"))


def _at_scores(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by, "score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("q"))


def roc_auc(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, auc: ties count half; null with one class alone."""
    t = running(_at_scores(rows, by), "score", {"under": "q"}, by, strict=True)
    won = F.sum(F.col("p") * (F.col("under") + F.col("q") / 2.0))
    return t.groupBy(*by).agg(F.try_divide(won, (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def roc_curve(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, score, tp, fp: what lies at or above each distinct score."""
    return running(_at_scores(rows, by), "score", {"tp": "p", "fp": "q"}, by, descending=True).select(*by, "score", "tp", "fp")


def best_f1_threshold(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, threshold: the highest score with the best F1, in [0, 1]; without positives the deny bound."""
    whole = Window.partitionBy(*by)
    c = roc_curve(rows, by).withColumn("pos", F.max("tp").over(whole))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.lit(0.0))
    best = c.groupBy(*by).agg(F.max(F.struct(F.round(f1, 12).alias("f1"), "score")).alias("b"), F.max("pos").alias("pos"))
    return best.select(*by, F.when(F.col("pos") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.score")))).otherwise(M.DENY).alias("threshold"))


def seed_summary(rows: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """by, mean, std (sample; 0 for one seed); NaN doesn't count."""
    v = F.nanvl(F.col(value), F.lit(None))
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"))


def by_group_with_means(rows: DataFrame) -> DataFrame:
    """grp, rows, positives, auc, mean score of benign and of malicious rows, for (y, score, source) in overlapping groups."""
    g = in_groups(rows, F.col("source"))
    mean = lambda y: F.avg(F.when(F.col("y") == y, F.col("score")))
    sizes = g.groupBy("grp").agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"), mean(0).alias("benign_mean"), mean(1).alias("malicious_mean"))
    return sizes.join(roc_auc(g, ("grp",)), "grp")


def percentiles(rows: DataFrame, value: str, by: tuple[str, ...], accuracy: int | None = None) -> DataFrame:
    """by, p50, p95, mean; exact at any size, or within rank error 1 / ``accuracy`` in one pass."""
    mean = F.avg(value).alias("mean")
    if accuracy is not None:
        p = lambda q: F.percentile_approx(value, q, accuracy)
        return rows.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), mean)
    at, means = quantiles(rows, value, {"p50": 0.5, "p95": 0.95}, by).alias("q"), rows.groupBy(*by).agg(mean).alias("m")
    both = means.join(at, [F.col(f"m.{k}").eqNullSafe(F.col(f"q.{k}")) for k in by] or F.lit(True), "left")  # one row a group
    return both.select(*[F.col(f"m.{k}") for k in by], "p50", "p95", "mean")


def in_groups(rows: DataFrame, source: Column) -> DataFrame:
    """Each row in its source's group, in ``all``, and in ``non-http`` unless it is http."""
    groups = F.array_compact(F.array(source, F.lit("all"), F.when(source != "http", F.lit("non-http"))))
    return rows.withColumn("grp", F.explode(groups))
