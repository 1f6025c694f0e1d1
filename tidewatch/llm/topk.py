"""Exact top-k by inner product: blocks in order of length, rotated partial sums, residual bounds.

Every component x becomes floor(64 x), so scores are integers. Candidates and queries are dealt
into blocks of bounded size; candidates by falling length, so that a block's greatest length
bounds all its scores. A block pair is one task: first the whole block against each query's
known floor (Cauchy-Schwarz with the lengths), then partial sums over the leading axes of an
SVD rotation with the rest bounded by the residual lengths, then the exact integer products of
what is left. Each pair of blocks gives at most k rows a query, which are ranked at the end.

A query needs candidates of its floor over its own length at least: query blocks are made by that
need, and a block pair is only made, and its rows only sent, where the candidates' greatest length
reaches the least need of the queries. The floors come from a first look: each query against one bounded block of the longest vectors;
the k-th best there is a lower bound of the k-th best overall.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
vectors of other lengths than a query's are no candidates of it; a null id takes no part; repeated
rows count as rows of their own, but a query's own id is never its candidate; ties go to the
smaller id; fewer candidates than k give them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.llm.common import materialise, table

K = 20
SCALE = 64
#: Rows of a candidate block and of a query block, about; axes of the partial sums.
CANDIDATES, QUERIES, AXES = 8_192, 2_048, 24
#: Vectors that the rotation is fitted on.
ROTATION_ROWS = 4_096
#: Products of integers below this are exact in doubles.
EXACT = 2.0**53


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v array<long>, dim, length: the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    got = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return got.select("id", "v", F.size("v").alias("dim"), length.alias("length"))


def rotation(parts: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of a bounded sample, leading axis first."""
    rows = parts.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(ROTATION_ROWS).select("v").collect()  # bounded
    x = np.array([r["v"] for r in rows], float).reshape(-1, dim)
    if not len(x):
        return np.eye(dim)
    _, _, vt = np.linalg.svd(x, full_matrices=True)
    return vt.T


def best_of(q_ids, q, floors, c_ids, c, axes: np.ndarray, k: int) -> tuple[list, list, list]:
    """Rows (query, candidate, score) with all that can be among each query's k best."""
    n_q, n_c = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    slack = 1e-6 * (n_q.max(initial=0) * n_c.max(initial=0) + 1)
    live = np.flatnonzero(n_q * n_c.max(initial=0) + slack >= floors)
    out: tuple[list, list, list] = ([], [], [])
    if not live.size:
        return out
    qr, cr = q[live] @ axes, c @ axes
    rest_q = np.sqrt(np.maximum(0, n_q[live] ** 2 - (qr * qr).sum(axis=1)))
    rest_c = np.sqrt(np.maximum(0, n_c**2 - (cr * cr).sum(axis=1)))
    exact = float(n_q.max()) * float(n_c.max()) * 4 < EXACT
    for lo in range(0, len(live), 256):
        rows = live[lo : lo + 256]
        bound = qr[lo : lo + 256] @ cr.T + rest_q[lo : lo + 256, None] * rest_c[None, :]
        able = bound + slack >= floors[rows, None]
        cols = np.flatnonzero(able.any(axis=0))
        if not cols.size:
            continue
        if exact:
            s = q[rows] @ c[cols].T
        else:
            s = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c[cols]] for x in q[rows]], object)
        for i, r in enumerate(rows.tolist()):
            mine = cols[able[i, cols] & (c_ids[cols] != q_ids[r])]
            if not mine.size:
                continue
            score = s[i][np.searchsorted(cols, mine)]
            if len(mine) > k:
                order = np.lexsort((c_ids[mine], -score)) if exact else np.array(sorted(range(len(mine)), key=lambda j: (-score[j], c_ids[mine[j]])))
                order = order[:k]
                mine, score = mine[order], score[order]
            out[0].extend([int(q_ids[r])] * len(mine))
            out[1].extend(c_ids[mine].tolist())
            out[2].extend(int(x) for x in score)
    return out


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, <id_col>, score: each query row's ``k`` best among all other rows.

    ``is_query`` is a condition on the column ``id`` (a long).
    """
    own = materialise(integers(vectors, id_col, vec_col), "vectors")
    sizes = own.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.when(is_query, 1).otherwise(0)).alias("m")).orderBy("dim").collect()  # one row a dimension
    outs = [_of_one_dimension(own.where(F.col("dim") == r["dim"]), is_query, r["dim"], r["n"], r["m"], k) for r in sizes if r["m"]]
    if not outs:
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])
        return vectors.sparkSession.createDataFrame([], schema)
    found = outs[0]
    for x in outs[1:]:
        found = found.unionByName(x)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "cand")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("cand").alias(id_col), "score")


def cuts_of(values: DataFrame, blocks: int) -> np.ndarray:
    """Rising bounds that part column x into about ``blocks`` blocks of equal depth; block i ends at bound i, the last has none."""
    if blocks < 2:
        return np.zeros(0)
    return np.unique(values.approxQuantile("x", [i / blocks for i in range(1, blocks)], 0.25 / blocks))


def _of_one_dimension(own: DataFrame, is_query: Column, dim: int, n: int, m: int, k: int) -> DataFrame:
    axes = rotation(own, dim)[:, : min(AXES, dim)]
    longest = own.orderBy(F.col("length").desc(), "id").limit(CANDIDATES).select("id", "v", "length").collect()  # one block
    top_ids, top_v = np.array([r["id"] for r in longest], np.int64), np.array([r["v"] for r in longest], float).reshape(-1, dim)
    # blocks of equal depth by length; a hash parts equal lengths
    spread = F.lit(1e-9) * F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    depth = F.col("length") + spread * (F.col("length") + 1)
    cuts = cuts_of(own.select(depth.alias("x")), -(-n // CANDIDATES))
    shared = own.sparkSession.sparkContext.broadcast((axes, top_ids, top_v, cuts))

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, ids, v, _ = shared.value
        for b in batches:
            q = np.array(b["v"].tolist(), float).reshape(-1, dim)
            low = np.full(len(q), -np.inf)
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ v.T
                s[b["id"].to_numpy()[lo : lo + 256, None] == ids[None, :]] = -np.inf
                if s.shape[1] >= k:
                    low[lo : lo + 256] = np.partition(s, -k, axis=1)[:, -k]
            yield b.assign(floor=low)

    # the least length that a candidate of the query must have; a tolerance covers the division's rounding
    need = F.when(F.col("length") > 0, F.col("floor") / F.col("length") * (1 - F.signum("floor") * 1e-9)).otherwise(F.when(F.col("floor") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    queries = own.where(is_query).select("id", "v", "length").mapInPandas(floors, "id long, v array<double>, length double, floor double")
    queries = materialise(queries.select("id", "v", "floor", F.greatest(need, F.lit(0.0)).alias("need")), "queries")
    wanted = F.col("need") + spread * (F.least("need", F.lit(1e300)) + 1)
    q_cuts = cuts_of(queries.select(wanted.alias("x")), -(-m // QUERIES))
    q_shared = own.sparkSession.sparkContext.broadcast((q_cuts, cuts))

    def query_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query in block q, once for each candidate block that can hold what it needs."""
        q_at, c_at = q_shared.value
        for b in batches:
            first = np.searchsorted(c_at, b["need"].to_numpy())
            yield b.assign(q=np.searchsorted(q_at, b["x"].to_numpy()), first=np.minimum(first, len(c_at)))

    def candidate_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A candidate in block c, with the last query block whose least need its block's greatest length reaches."""
        q_at, c_at = q_shared.value
        for b in batches:
            c = np.searchsorted(c_at, b["x"].to_numpy())
            most = np.append(c_at, np.inf)[c]
            yield b.assign(c=c, last=np.searchsorted(q_at, most + 2e-9 * (most + 1)))  # a query's place lies a little above its need

    placed = queries.withColumn("x", wanted).mapInPandas(query_blocks, "id long, v array<double>, floor double, need double, x double, q long, first long")
    left = placed.select("id", "v", "floor", "q", F.explode(F.sequence(F.col("first"), F.lit(len(cuts)).cast("long"))).alias("c"))
    cand = own.withColumn("x", depth).select("id", "v", "x").mapInPandas(candidate_blocks, "id long, v array<double>, x double, c long, last long")
    right = cand.select("id", "v", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("q"))

    def pair(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "cand": [], "score": []}).astype("int64")
        a, b = np.array(qs["v"].tolist(), float), np.array(cs["v"].tolist(), float)
        rows = best_of(qs["id"].to_numpy(), a, qs["floor"].to_numpy(), cs["id"].to_numpy(), b, shared.value[0], k)
        return pd.DataFrame({"query_id": np.array(rows[0], np.int64), "cand": np.array(rows[1], np.int64), "score": np.array(rows[2], np.int64)})

    return left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(pair, "query_id long, cand long, score long")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)
