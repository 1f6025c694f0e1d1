"""Hard negatives by a block matrix product: tiles of scores, added up over chunks of dimensions.

Each component x becomes floor(256 x). Rows are dealt into row blocks by a hash, and their vectors
into chunks of dimensions; a task multiplies one anchor block by one candidate block over one chunk
and hands on its partial int64 scores in strips of a few anchors. The shuffle adds a strip's
partial scores up over the chunks, and what is left of it is at most a few rows an anchor.

Positives first: only rows of the anchor's label meet, blocks being made within labels, and a strip
keeps each anchor's k best. Then all rows meet the anchors, which carry their positives' scores: a
strip keeps, for each anchor and positive, the k best rows of other labels within the window. A
ranking over all strips gives the result. Rows sent grow with anchors times rows, as the task does;
every task and every strip is bounded.

Defined results: rows with a null id or label, or a vector that is null, empty or holds null or
non-finite components, take no part, nor do vectors of (scaled) length 2^29 and more, whose scores
need not fit 64 bits; vectors of different dimensions don't meet; of several rows with one id the
one of the least label, then vector, counts; ties go to the smaller id; an empty table, anchors
without positives and positives without negatives give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import materialise, table

SCALE, K = 256, 5
#: A negative's score is LOW to HIGH percent of the positive's.
LOW, HIGH = 80, 100
#: Rows of an anchor block and of a candidate block, about; anchors of a strip.
ANCHORS, CANDIDATES, STRIP = 1_024, 4_096, 64
#: Dimensions of a chunk; vectors of more than CHUNKS times as many have wider ones.
DIMS, CHUNKS = 32, 32
#: Products of integers below this are exact in doubles.
EXACT = 2.0**53

SCORES = "anchor_id long, id long, score long"
WINDOWS = "anchor_id long, positive_id long, positive_score long, id long, score long"


def participants(vectors: DataFrame, label: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, label, v array<long>, dim, length: one row an id."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).where(F.col("length") < 2.0**29)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v", "length")).alias("r")).select("id", "r.*")
    return one.withColumn("dim", F.size("v"))


def _flat(col: pa.ChunkedArray) -> np.ndarray:
    """The rows x width matrix of a list column whose lists have one width."""
    return col.combine_chunks().flatten().to_numpy().reshape(len(col), -1)


def _lists(values: np.ndarray, ends: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def partial_tile(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Strips of a block pair's partial scores over one chunk of dimensions, as int64 bytes."""
    if not anchors.num_rows or not rows.num_rows:
        return TILE.empty_table()
    anchors, rows = anchors.sort_by("id"), rows.sort_by("row_id")
    x, y = _flat(anchors["part"]), _flat(rows["row_part"])
    if float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max() * (y.astype(float) ** 2).sum(axis=1).max())) < EXACT / 4:
        tile = np.rint(x.astype(float) @ y.T.astype(float)).astype(np.int64)
    else:
        tile = x @ y.T
    first = anchors["chunk"][0].as_py() == 0
    out: dict[str, list] = {name: [] for name in TILE.names}
    ids, labels = (rows[f"row_{c}"].to_numpy().astype(np.int64).tobytes() for c in ("id", "label"))
    for lo in range(0, len(x), STRIP):
        own = anchors.slice(lo, STRIP)
        out["g"].append(key[0].as_py())
        out["a"].append(key[1].as_py())
        out["c"].append(key[2].as_py())
        out["strip"].append(lo // STRIP)
        out["tile"].append(tile[lo : lo + STRIP].tobytes())
        # what the chunks have in common goes with the first one
        out["ids"].append(ids if first else None)
        out["labels"].append(labels if first else None)
        for c in ("id", "label"):
            out[f"anchor_{c}"].append(own[c].to_numpy().astype(np.int64).tobytes() if first else None)
        for c in ("positive_ids", "positive_scores"):
            out[c].append(own[c].to_pylist() if first else None)
    return pa.Table.from_pydict(out, TILE)


TILE = pa.schema([
    ("g", pa.string()), ("a", pa.int64()), ("c", pa.int64()), ("strip", pa.int64()), ("tile", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchor_id", pa.binary()), ("anchor_label", pa.binary()),
    ("positive_ids", pa.list_(pa.list_(pa.int64()))), ("positive_scores", pa.list_(pa.list_(pa.int64()))),
])
TILE_SQL = "g string, a long, c long, strip long, tile binary, ids binary, labels binary, anchor_id binary, anchor_label binary, positive_ids array<array<long>>, positive_scores array<array<long>>"


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties by place."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return at[np.argsort(-scores[at], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")


def positives_of(strip: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, own: np.ndarray, with_: tuple, k: int) -> Iterator[tuple]:
    """(anchor, id, score): each anchor's k best rows of its label."""
    for s, anchor, label in zip(strip, anchors.tolist(), own.tolist(), strict=True):
        able = np.flatnonzero((labels == label) & (ids != anchor))
        for j in able[best(s[able], k)].tolist():
            yield anchor, int(ids[j]), int(s[j])


def negatives_of(strip: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, own: np.ndarray, with_: tuple, k: int, low: int = LOW, high: int = HIGH) -> Iterator[tuple]:
    """(anchor, positive, its score, id, score): for each positive the k best rows of other labels in its window."""
    for s, anchor, label, pids, scores in zip(strip, anchors.tolist(), own.tolist(), *with_, strict=True):
        other = labels != label
        # floor and ceiling in whole numbers
        spans = [(-(-low * p // 100), high * p // 100) for p in scores]
        least, most = min(a for a, _ in spans), max(z for _, z in spans)
        able = np.flatnonzero(other & (s >= least) & (s <= most))
        able = able[np.argsort(-s[able], kind="stable")]
        falling = -s[able]
        for pid, p, (a, z) in zip(pids, scores, spans, strict=True):
            lo = int(np.searchsorted(falling, -z, side="left"))
            for j in able[lo : lo + k].tolist():
                if s[j] < a:
                    break
                yield anchor, pid, p, int(ids[j]), int(s[j])


def added(take: Callable, k: int, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Adds a strip's partial scores up and takes what may count of it."""

    def run(strips: pa.Table) -> pa.Table:
        total = None
        for x in strips["tile"]:
            part = np.frombuffer(x.as_buffer(), np.int64)
            total = part.copy() if total is None else np.add(total, part, out=total)
        first = strips.filter(strips["ids"].is_valid()).slice(0, 1).to_pylist()[0]
        ids, labels, anchors, own = (np.frombuffer(first[c], np.int64) for c in ("ids", "labels", "anchor_id", "anchor_label"))
        got = list(take(total.reshape(len(anchors), len(ids)), ids, labels, anchors, own, (first["positive_ids"], first["positive_scores"]), k))
        columns = zip(*got, strict=True) if got else [[] for _ in names]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def product(anchors: DataFrame, rows: DataFrame, take: Callable, schema: str, k: int) -> DataFrame:
    """What ``take`` takes of the strips of anchors x rows.

    Both have g (groups that meet), id, label, v, dim; n_a and n_c say how many blocks the group's anchors
    and rows are dealt into. Anchors have positive_ids and positive_scores (nulls where there are none).
    """
    width = F.greatest(F.lit(DIMS), F.ceil(F.col("dim") / CHUNKS).cast("int"))
    chunks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("dim") / width).cast("int") - 1)).alias("chunk")
    part = F.slice("v", F.col("chunk") * width + 1, width).alias("part")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    others = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    left = anchors.select("*", block("n_a").alias("a"), chunks).select("g", "id", "label", "positive_ids", "positive_scores", "n_c", "a", "chunk", part)
    left = left.select("g", "a", others("n_c", "c"), "chunk", "id", "label", "part", "positive_ids", "positive_scores")
    right = rows.select("*", block("n_c").alias("c"), chunks).select("g", "id", "label", "n_a", "c", "chunk", part)
    right = right.select("g", others("n_a", "a"), "c", "chunk", "id", "label", "part")
    right = right.select(*[F.col(c).alias(f"row_{c}") for c in right.columns])  # no column is both sides'
    keys = ["g", "a", "c", "chunk"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*[f"row_{k}" for k in keys])).applyInArrow(partial_tile, TILE_SQL)
    return tiles.groupBy("g", "a", "c", "strip").applyInArrow(added(take, k, [x.split()[0] for x in schema.split(", ")]), schema)


def sized(rows: DataFrame, is_anchor: Column, anchors: int, candidates: int) -> DataFrame:
    """Adds n_a and n_c to the rows of groups g that hold anchors; other groups' rows go."""
    blocks = lambda n, size: F.greatest(F.lit(1).cast("long"), F.ceil(n / size).cast("long"))
    sizes = rows.groupBy("g").agg(blocks(F.count("*"), candidates).alias("n_c"), F.sum(F.when(is_anchor, 1).otherwise(0)).alias("n")).where("n > 0")
    return rows.join(sizes.select("g", "n_c", blocks(F.col("n"), anchors).alias("n_a")), "g")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, positives: int = K, low: int = LOW, high: int = HIGH, anchors: int = ANCHORS, candidates: int = CANDIDATES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor``, a condition on the column ``id``, holds; ``label`` is a
    column of ``vectors``.
    """
    rows = materialise(participants(vectors, label, id_col=id_col, vec_col=vec_col), "vectors")
    none = F.lit(None).cast("array<long>")
    alike = materialise(sized(rows.withColumn("g", F.concat_ws(":", "dim", "label")), is_anchor, anchors, candidates), "alike")
    own = alike.where(is_anchor).withColumns({"positive_ids": none, "positive_scores": none})
    found = product(own, alike, positives_of, SCORES, positives)
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    top = found.withColumn("r", F.row_number().over(by_anchor)).where(F.col("r") <= positives)
    with_ = top.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("p"))
    with_ = materialise(with_.select(F.col("anchor_id").alias("id"), F.col("p.id").alias("positive_ids"), F.col("p.score").alias("positive_scores")), "positives")
    every = sized(rows.withColumn("g", F.col("dim").cast("string")), is_anchor, anchors, candidates)
    take = lambda *a: negatives_of(*a, low=low, high=high)
    kept = product(every.where(is_anchor).join(with_, "id"), every, take, WINDOWS, k)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    out = kept.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0, label)
