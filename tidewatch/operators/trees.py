"""Class forests as tables of nodes: a bound on each tree's leaves, and scores from the table.

A node's split does not depend on other nodes, so a tree grown best split first up to a number of leaves is the fully
grown tree with only its best splits kept, taken in that order. Each tree is cut in a task of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leaves of a tree; nodes that a worker may hold for scoring (a larger forest is refused).
LEAVES, MOST_NODES = 4096, 8_000_000

NODES = "tree int, id int, weight double, value double, gain double, feature int, threshold double, low int, high int"


def at_most(nodes: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """``nodes`` (as of ``explain.nodes``) of each tree as if grown best split first to ``leaves`` leaves.

    The best split takes most impurity off, weighted by the node's share of rows; ties go to the smaller id.
    """
    if leaves < 1:
        raise ValueError("a tree has a leaf")

    def cut(tree: pd.DataFrame) -> pd.DataFrame:
        t = tree.set_index("id").sort_index()
        inner, low, high, gain = (dict(t[c]) for c in ("feature", "low", "high", "gain"))
        kept, open_, seen = set(), [(-gain[0], 0)] if inner[0] >= 0 else [], {0}
        while open_ and len(kept) + 1 < leaves:
            _, at = heapq.heappop(open_)
            kept.add(at)
            for child in (int(low[at]), int(high[at])):
                seen.add(child)
                if inner[child] >= 0:
                    heapq.heappush(open_, (-gain[child], child))
        out = t.loc[sorted(seen)].reset_index()
        leaf = ~out["id"].isin(kept)
        out.loc[leaf, ["feature", "low", "high"]] = -1
        return out.assign(threshold=out["threshold"].where(~leaf), gain=out["gain"].where(~leaf, 0.0))[tree.columns]

    names = [c.split()[0] for c in NODES.split(", ")]
    return nodes.select(*names).groupBy("tree").applyInPandas(cut, NODES)


def probability(nodes: DataFrame, rows: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``rows`` with the mean of their leaves' values over the trees; the nodes go to the workers, their number checked."""
    if (n := nodes.count()) > MOST_NODES:
        raise ValueError(f"{n} nodes, more than {MOST_NODES}")
    t = nodes.select("tree", "id", "feature", "threshold", "low", "high", "value").toPandas().sort_values(["tree", "id"]).reset_index(drop=True)  # bounded
    place = pd.Series(t.index, index=pd.MultiIndex.from_frame(t[["tree", "id"]]))
    inner = t["feature"].to_numpy() >= 0
    to = {side: np.zeros(len(t), np.int32) for side in ("low", "high")}
    for side, at in to.items():
        at[inner] = place.loc[pd.MultiIndex.from_frame(t.loc[inner, ["tree", side]])].to_numpy()
    arrays = (t["feature"].to_numpy(), t["threshold"].to_numpy(float), to["low"], to["high"], t["value"].to_numpy(float), place.index.get_indexer([(k, 0) for k in t["tree"].unique()]))
    shared = rows.sparkSession.sparkContext.broadcast(arrays)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, threshold, low, high, value, roots = shared.value
        for cols in parts:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            total = np.zeros(len(x))
            for root in roots:
                at = np.full(len(x), root)
                while (go := np.flatnonzero(feature[at] >= 0)).size:
                    n = at[go]
                    at[go] = np.where(x[go, feature[n]] <= threshold[n], low[n], high[n])
                total += value[at]
            yield pd.Series(total / len(roots))

    return rows.withColumn(out, score(*[F.col(c) for c in columns]))
