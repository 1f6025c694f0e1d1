"""The ledger's layout for look-ups, the one order over files, and bounds on trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import explain, lookup, models, trees
from tidewatch.sources import sinks


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    leaves, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
        if p.nodeName().startswith("Scan"):
            leaves.append(p.metrics().apply("numFiles").value())
    return sum(leaves)


def parts_as_they_are(spark, request):
    """Small parts are not put together within a test."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    request.addfinalizer(lambda: spark.conf.unset(name))


def records(spark, n=4000):
    i = F.col("id")
    # a third of all rows are of one principal; some principals and resources are null
    principal = F.when(i % 3 == 0, "hot").when(i % 50 == 1, None).otherwise(F.concat(F.lit("p"), (i % 97).cast("string")))
    resource = F.when(i % 41 == 0, None).otherwise(F.concat(F.lit("r"), (i % 211).cast("string")))
    return spark.range(n).select(principal.alias("principal"), i.alias("seq"), resource.alias("resource"), (i * 7).alias("more"))


def test_look_ups_read_a_share_of_the_files(spark, tmp_path):
    path, t = f"{tmp_path}/ledger", records(spark)
    lookup.lay_out(t, path, buckets=16, chain_rows=500)
    rows = lambda df: sorted(map(tuple, df.collect()))
    files = len(spark.read.parquet(f"{path}/records").inputFiles())
    for p in ("hot", "p5", "none"):
        got = lookup.by_principal(spark, path, p, 16).select(t.columns)
        seqs = [r["seq"] for r in got.collect()]
        assert rows(got) == rows(t.where(F.col("principal") == p)) and seqs == sorted(seqs)
    assert 0 < files_read(lookup.by_principal(spark, path, "p5", 16)) < files / 4
    for r in ("r5", "none"):
        assert rows(lookup.by_resource(spark, path, r, 16).select(t.columns)) == rows(t.where(F.col("resource") == r))
    assert spark.read.parquet(f"{path}/records").count() == 4000


def test_a_rare_resource_reads_its_own_buckets(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    t = records(spark).withColumn("resource", F.when(F.col("principal") == "p5", "rare").otherwise(F.col("resource")))
    lookup.lay_out(t, path, buckets=16)
    got = lookup.by_resource(spark, path, "rare", 16)
    assert got.count() == t.where("resource = 'rare'").count() > 0
    assert files_read(got) < len(spark.read.parquet(f"{path}/records").inputFiles()) / 4


def test_a_long_chain_goes_over_files(spark, tmp_path, request):
    path = f"{tmp_path}/ledger"
    parts_as_they_are(spark, request)
    lookup.lay_out(spark.range(2000).select(F.lit("one").alias("principal"), F.col("id").alias("seq"), F.lit("r").alias("resource")).repartition(8), path, buckets=4, chain_rows=100)
    files = spark.read.parquet(f"{path}/records").select(F.input_file_name().alias("f"), "seq").groupBy("f").count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 2000


def test_an_empty_ledger(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    lookup.lay_out(records(spark).limit(1), path)
    assert lookup.by_principal(spark, path, "nobody").count() == 0 == lookup.by_resource(spark, path, "nothing").count()


def test_places_in_one_order(spark, tmp_path, request):
    rng = np.random.default_rng(0)
    rows = [(int(t), int(i), str(t)) for i, t in zip(rng.permutation(3000), rng.integers(0, 400, 3000), strict=True)]
    path = f"{tmp_path}/merged"
    parts_as_they_are(spark, request)
    sinks.write_ordered(spark.createDataFrame(rows, "ts long, event_id long, more string").repartition(6), path)
    assert len(spark.read.parquet(path).inputFiles()) > 1
    got = sinks.read_placed(spark, path)
    assert [(r["place"], r["ts"], r["event_id"]) for r in got.orderBy("place").collect()] == [(n + 1, t, i) for n, (t, i, _) in enumerate(sorted(rows))]
    assert "hashpartitioning" not in got.select("place", "more")._jdf.queryExecution().toString().split("Physical Plan")[-1].split("BroadcastExchange")[0]


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=900) > 0).astype(int)
    t = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, label int")
    t = t.cache()
    model = models.fitted(t, list("abc"), "label", "forest", numTrees=4, maxDepth=7)
    return t, model, explain.nodes(spark, model).cache()


def test_scores_from_the_table_are_the_model_s(spark, forest):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    t, model, nodes = forest
    want = {r["id"]: r["p"] for r in model.transform(VectorAssembler(inputCols=list("abc"), outputCol="_x").transform(t)).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    for table in (nodes, trees.at_most(nodes, 10_000)):
        got = {r["id"]: r["r"] for r in trees.probability(table, t, list("abc"), "r").collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


@pytest.mark.parametrize("leaves", [1, 2, 9])
def test_trees_grow_best_split_first(forest, leaves):
    _, _, nodes = forest
    every = {(r["tree"], r["id"]): r for r in nodes.collect()}
    got = {(r["tree"], r["id"]): r for r in trees.at_most(nodes, leaves).collect()}
    for tree in range(4):
        own = {i: r for (k, i), r in got.items() if k == tree}
        leaf = [i for i, r in own.items() if r["feature"] < 0]
        assert len(leaf) == leaves and len(own) == 2 * leaves - 1
        assert all(own[i]["value"] == every[tree, i]["value"] for i in own)
        frontier, splits = [0], []  # plainly: the best open node is split until there are enough leaves
        while len(splits) < leaves - 1:
            best = min((i for i in frontier if every[tree, i]["feature"] >= 0), key=lambda i: (-every[tree, i]["gain"], i))
            splits.append(best)
            frontier = [i for i in frontier if i != best] + [every[tree, best]["low"], every[tree, best]["high"]]
        assert sorted(frontier) == sorted(leaf) and sorted(splits) == sorted(set(own) - set(leaf))


def test_contributions_follow_a_bounded_forest(spark, forest):
    _, _, nodes = forest
    small = trees.at_most(nodes, 5)
    paths = explain.leaf_paths(small)
    assert paths.count() == 20
    assert paths.groupBy("tree").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_limits(forest, monkeypatch):
    t, _, nodes = forest
    with pytest.raises(ValueError, match="a leaf"):
        trees.at_most(nodes, 0)
    monkeypatch.setattr(trees, "MOST_NODES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        trees.probability(nodes, t, list("abc"), "r")


def test_tamper_table_counts_what_is_found_in_its_place(spark):
    from tidewatch.operators import ledger

    done = spark.createDataFrame([("a", 3, "delete", True), ("a", 1, "modify", True), ("b", 2, "delete", True), ("c", 5, "delete", False), ("gone", 1, "modify", True)], "principal string, seq long, kind string, succeeded boolean")
    verdicts = spark.createDataFrame([("a", 2), ("b", -1), ("c", 4)], "principal string, first_discontinuity long")
    got = {r["kind"]: tuple(r)[1:] for r in ledger.tamper_table(done, verdicts).collect()}
    assert got == {"delete": (3, 2, 1), "modify": (2, 2, 0), "total": (5, 4, 1)}
    assert ledger.tamper_table(done.where("seq < 0"), verdicts).count() <= 1
