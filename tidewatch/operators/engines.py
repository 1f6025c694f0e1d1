"""Risk engines: two fitted detectors, their calibration, and the fused score; kept, loaded, recalibrated, by type.

Fitting takes all rows and works in tasks; the calibration scores are a table, so scoring and calibrating
stay distributed.
"""

from __future__ import annotations

import io
import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import model as M
from tidewatch.functions import columns as C
from tidewatch.operators import calibrate, models
from tidewatch.session import materialise

#: Benign training rows that a type needs for an engine of its own.
LEAST_ROWS = 400


@dataclass
class Engine:
    """``calibration``: (kind, e, s) of benign validation rows; ``typed``: calibrate by kind where it has enough of them."""

    forest: models.Forest
    net: models.Autoencoder
    columns: tuple[str, ...]
    calibration: DataFrame
    alpha: float = M.ALPHA
    typed: bool = True


def raw(rows: DataFrame, forest: models.Forest, net: models.Autoencoder, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with e and s, rounded, so that equal scores are equal."""
    both = models.scored(models.scored(rows, net, list(columns), "e"), forest, list(columns), "s")
    return both.withColumns({"e": F.round("e", 9), "s": F.round("s", 9)})


def calibrated_on(engine: Engine, val: DataFrame, typed: bool = True) -> Engine:
    """The engine with its calibration taken anew from benign ``val`` rows; nothing is retrained."""
    scores = raw(val, engine.forest, engine.net, engine.columns).select("kind", "e", "s")
    return replace(engine, calibration=materialise(scores, "calibration"), typed=typed)


def fit(train: DataFrame, val: DataFrame, columns: tuple[str, ...], *, key: str = "event_id", alpha: float = M.ALPHA, typed: bool = True) -> Engine:
    """Both detectors on benign ``train`` rows, the calibration on benign ``val`` rows (with kind)."""
    forest, net = (f(train, list(columns), key) for f in (models.fit_forest, models.fit_autoencoder))
    return calibrated_on(Engine(forest, net, tuple(columns), val, alpha), val, typed)


def score(engine: Engine, rows: DataFrame, alphas: tuple[float, ...] | None = None) -> DataFrame:
    """``rows`` (with kind) and e, s, f_e, f_s and r_<alpha> for each weight."""
    out = materialise(raw(rows, engine.forest, engine.net, engine.columns), "scores")  # each distribution reads them again
    for x in ("e", "s"):
        if engine.typed:
            out = calibrate.ecdf_with_fallback(engine.calibration, out, x, "kind").withColumnRenamed("f", f"f_{x}")
        else:
            out = calibrate.ecdf(engine.calibration, out, x, (), f"f_{x}").drop("_rows")
    return out.withColumns({f"r_{a}": C.fuse(F.col("f_e"), F.col("f_s"), a) for a in alphas or (engine.alpha,)})


# --- by type -------------------------------------------------------------------------------


def fit_by_type(train: DataFrame, val: DataFrame, columns: tuple[str, ...], *, key: str = "event_id", least: int = LEAST_ROWS) -> tuple[dict[str, Engine], str]:
    """An engine for each kind with ``least`` rows, and the kind with most rows as default; kinds are few."""
    counts = {r["kind"]: r["count"] for r in train.groupBy("kind").count().collect()}
    kinds = sorted(k for k, n in counts.items() if n >= least) or sorted(counts)[:1]
    if not kinds:
        raise ValueError("no rows to fit on")
    engines = {k: fit(train.where(F.col("kind") == k), val.where(F.col("kind") == k), columns, key=key, typed=False) for k in kinds}
    return engines, max(kinds, key=lambda k: (counts[k], k))


def score_by_type(engines: dict[str, Engine], default: str, rows: DataFrame, alphas: tuple[float, ...] | None = None) -> DataFrame:
    """Each row by its kind's engine, or by the default one; ``engine`` says which."""
    which = F.when(F.col("kind").isin(*engines), F.col("kind")).otherwise(default)
    rows, out = rows.withColumn("engine", which), None
    for kind, engine in sorted(engines.items()):
        one = score(engine, rows.where(F.col("engine") == kind), alphas)
        out = one if out is None else out.unionByName(one)
    return out


# --- kept engines --------------------------------------------------------------------------


def _arrays(engine: Engine) -> bytes:
    values: dict[str, np.ndarray] = {f"forest.{k}": np.asarray(v) for k, v in vars(engine.forest).items()}
    for k, v in vars(engine.net).items():
        values |= {f"net.{k}.{i}": x for i, x in enumerate(v)} if isinstance(v, list) else {f"net.{k}": v}
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **values)
    return buffer.getvalue()


def save(engine: Engine, path: str) -> None:
    """The detectors' arrays and settings as one row, the calibration as a table."""
    spark = engine.calibration.sparkSession
    settings = json.dumps({"columns": engine.columns, "alpha": engine.alpha, "typed": engine.typed})
    spark.createDataFrame([(settings, _arrays(engine))], "settings string, arrays binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
    engine.calibration.write.mode("overwrite").parquet(f"{path}/calibration")


def load(spark: SparkSession, path: str) -> Engine:
    row = spark.read.parquet(f"{path}/models").first()  # one row
    settings, values = json.loads(row["settings"]), np.load(io.BytesIO(bytes(row["arrays"])))
    forest = {k.split(".")[1]: values[k] for k in values.files if k.startswith("forest.")}
    forest["rows"] = int(forest["rows"])
    net: dict[str, object] = {}
    for k in sorted((k for k in values.files if k.startswith("net.")), key=lambda k: (k.split(".")[1], int((k.split(".") + ["0"])[2]))):
        name, *place = k.split(".")[1:]
        if place:
            net.setdefault(name, []).append(values[k])
        else:
            net[name] = values[k]
    return Engine(models.Forest(**forest), models.Autoencoder(**net), tuple(settings["columns"]), spark.read.parquet(f"{path}/calibration"), settings["alpha"], settings["typed"])


def save_by_type(engines: dict[str, Engine], default: str, path: str) -> None:
    spark = engines[default].calibration.sparkSession
    for kind, engine in engines.items():
        save(engine, f"{path}/{kind}")
    spark.createDataFrame([(sorted(engines), default)], "kinds array<string>, default string").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def load_by_type(spark: SparkSession, path: str) -> tuple[dict[str, Engine], str]:
    row = spark.read.parquet(f"{path}/index").first()  # one row
    return {k: load(spark, f"{path}/{k}") for k in row["kinds"]}, row["default"]
