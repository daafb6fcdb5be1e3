"""Graph, metric, ordering and label rules on small tables."""

import random

from pyspark.sql import functions as F

from riskweave.operators import aggregates as A
from riskweave.operators import graph as G
from riskweave.operators import joins as J
from riskweave.operators import metrics as E
from riskweave.operators import ordering as K


def test_node_fan_out(spark):
    rows = [("n", "x", 1.0, 0), ("n", "y", 3.0, 1), ("p", "n", 5.0, 0), ("q", "n", 7.0, 0), ("r", "n", 9.0, 0)]
    r = A.node_stats(spark.createDataFrame(rows, "src string, dst string, amount double, is_fraud int")).where("id = 'n'").first()
    assert (r["out_degree"], r["in_degree"], r["sum_out"], r["avg_in"], r["volume_per_txn"], r["label"]) == (2, 3, 4.0, 7.0, round(4 / 3, 4), 1)


def test_distances(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(20, 21), (21, 22), (22, 20)], "src long, dst long")
    got = {r["id"]: r["distance"] for r in G.distances(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {i: i for i in range(6)}
    ring = {r["id"]: r["distance"] for r in G.distances(edges, spark.createDataFrame([(20,)], "id long")).collect()}
    assert ring == {20: 0, 21: 1, 22: 1}


def test_average_precision_by_hand(spark):
    random.seed(5)
    rows = [(round(random.random(), 2), int(random.random() < 0.3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, tp, fp, want = sum(y for _, y in rows), 0, 0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        p = sum(y for t, y in rows if t == s)
        tp, fp = tp + p, fp + sum(1 - y for t, y in rows if t == s)
        want += p / pos * tp / (tp + fp)
    assert abs(E.average_precision(df, "s", "y").first()[0] - want) < 1e-6
    pairs = [(a > b) + 0.5 * (a == b) for a, x in rows for b, z in rows if x == 1 and z == 0]
    assert abs(E.roc_auc(df, "s", "y").first()[0] - sum(pairs) / len(pairs)) < 1e-6


def test_tied_scores(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 0)], "s double, y int")
    assert E.average_precision(df, "s", "y").first()[0] == 0.25 and E.roc_auc(df, "s", "y").first()[0] == 0.5


def test_overlap(spark):
    same = spark.createDataFrame([(float(i % 10), i // 10 % 2) for i in range(200)], "x double, y int")
    assert A.bhattacharyya(same, "x", "y").first()["overlap"] == 1.0
    apart = spark.createDataFrame([(float(i % 2 * 100), i % 2) for i in range(200)], "x double, y int")
    assert A.bhattacharyya(apart, "x", "y").first()["overlap"] == 0.0
    flat = spark.createDataFrame([(1.0, i % 2) for i in range(20)], "x double, y int")
    assert A.bhattacharyya(flat, "x", "y").first()["overlap"] == 1.0


def test_split_sizes(spark):
    for n in (1, 9, 10, 11):
        df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 50_000_000_000).alias("t"))
        c = {r["split"]: r["count"] for r in K.temporal_split(df, "t", "k").groupBy("split").count().collect()}
        assert c.get("train", 0) == int(n * 0.8) and sum(c.values()) == n
    nulls = spark.createDataFrame([(1, None), (2, 5)], "k long, t long")
    assert {r["k"]: r["split"] for r in K.temporal_split(nulls, "t", "k").collect()}[1] == "test"


def test_labels(spark):
    store = spark.createDataFrame([("a", "llm")], "transaction_id string, source string")
    batch = spark.createDataFrame([("a", "new"), ("b", "x"), ("b", "w")], "transaction_id string, source string")
    assert sorted(map(tuple, J.insert_absent(store, batch, "source").collect())) == [("a", "llm"), ("b", "w")]
    labels = spark.createDataFrame([("a", "llm", 0.4, None), ("b", "chargeback", 1.0, 0)], "transaction_id string, source string, weight double, chargeback_label int")
    told = spark.createDataFrame([("a", 1), ("b", 1)], "transaction_id string, is_fraud int")
    got = {r["transaction_id"]: (r["source"], r["chargeback_label"]) for r in J.apply_chargebacks(labels, told).collect()}
    assert got == {"a": ("chargeback", 1), "b": ("chargeback", 0)}


def test_noise_leaves_other_rows(spark):
    source = F.when(F.col("id") % 2 == 0, "elliptic_real")
    df = spark.range(400).select("id", (F.col("id") < 100).cast("int").alias("is_fraud"), (F.col("id") * 1.0).alias("amount_usd"), (F.col("id") % 24).cast("int").alias("hour_of_day"), F.lit(2.0).alias("velocity_ratio"), F.lit("cash").alias("transfer_type"), source.alias("source"))
    got = E.with_noise(df, "id").orderBy("id").collect()
    hit = [r for r in got if r["id"] < 100 and r["id"] % 2]
    rest = [r for r in got if r["id"] >= 100 or r["id"] % 2 == 0]
    assert all(r["amount_usd"] == float(r["id"]) and r["hour_of_day"] == r["id"] % 24 and r["transfer_type"] == "cash" for r in rest)
    assert sum(r["amount_usd"] != float(r["id"]) for r in hit) > 40 and all(r["amount_usd"] >= 0 and 0 <= r["hour_of_day"] <= 23 and r["velocity_ratio"] == 2.0 for r in hit)
    assert sum(r["transfer_type"] != "cash" for r in hit) == int(len(hit) * 0.2 * 0.5)
    again = E.with_noise(df.repartition(7), "id").orderBy("id").collect()
    assert again == got


def test_running_sums_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(k, round(rng.random() ** 9, 4)) for k in "aaaaaaab" for _ in range(150)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    q = K.quantiles(A.counted(df, "v", "k"), "v", "_c", {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p100": 1.0}, "k")
    import numpy as np

    for r in q.collect():
        values = [v for k, v in rows if k == r["k"]]
        assert np.allclose([r["p0"], r["p37"], r["p50"], r["p100"]], np.quantile(values, [0, 0.37, 0.5, 1]))
    s = K.running_sums(spark.range(1000).select("id", F.lit(1).cast("long").alias("one")), [], [F.desc("id")], ["one"])
    assert {r["id"]: (r["one_before"], r["one_all"]) for r in s.collect()} == {i: (999 - i, 1000) for i in range(1000)}


def test_few_labels_change_nothing(spark):
    training = spark.createDataFrame([("a", 1.0, 0)], "transaction_id string, x double, is_fraud int")
    rows = [(f"n{i}", "human", 0.7, False, None, 1, None, '{"x": %d}' % i) for i in range(4)] + [("a", "chargeback", 1.0, False, 1, 0, 0, '{"x": 9}'), ("w", "llm", 0.1, False, None, None, 1, "{}"), ("u", "llm", 0.9, True, None, None, 1, "{}"), ("b", "human", 0.9, False, None, 1, None, "no")]
    labels = spark.createDataFrame(rows, "transaction_id string, source string, weight double, included_in_training boolean, chargeback_label int, human_label int, llm_label int, features_json string")
    merged, marked = K.ingest_labels(training, labels, least=7)
    assert merged.count() == 1 and marked.where("included_in_training").count() == 1
    merged, marked = K.ingest_labels(training, labels, least=6)
    got = {r["transaction_id"]: (r["x"], r["is_fraud"], r["label_source"]) for r in merged.collect()}
    assert got == {"a": (9.0, 1, "chargeback"), **{f"n{i}": (float(i), 1, "human") for i in range(4)}}
    assert {r[0] for r in marked.where("included_in_training").select("transaction_id").collect()} == {"a", "b", "u", *(f"n{i}" for i in range(4))}
    assert [r["transaction_id"] for r in K.label_candidates(labels).collect()][:2] == ["a", "b"]


def test_models(spark):
    """Scores order separable rows; the importance finds the column that decides; a constant score counts nothing."""
    from riskweave.operators import learning as L

    rng = random.Random(2)
    rows = [(i, int(x > 0.6), x, rng.random(), "ab"[i % 2]) for i, x in enumerate(rng.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "id long, y int, amount double, noise double, kind string")
    for kind, params in (("logistic", {"maxIter": 50}), ("boosted", {"maxIter": 3, "maxDepth": 2}), ("forest", {"numTrees": 5, "maxDepth": 3, "seed": 1})):
        m = L.train(df, kind, ["amount", "noise"], ["kind"], "y", **params)
        scored = L.scored_by(m, df)
        assert E.average_precision(scored, "p", "y").first()[0] > 0.98 and scored.where("p < 0 OR p > 1").count() == 0
        assert L.importance(m, df).first()["feature"] == "amount"
    standard = L.train(df, "logistic", ["amount"], [], "y", maxIter=1).transform(df).select("x").toPandas()["x"]
    values = [float(v[0]) for v in standard]
    assert abs(sum(values)) < 1e-6
    runs = {r["run"]: r["pr_auc"] for r in L.tournament(df, df, {"good": ("logistic", {"maxIter": 20}), "flat": ("logistic", {"regParam": 1e9, "elasticNetParam": 1.0})}, ["amount"], [], "y", sample=300).collect()}
    assert runs["good"] > 0.9 and runs["flat"] == 0.0
    space = L.search_space(6)
    assert len(space) == 6 and space == L.search_space(6)
    assert all(200 <= p["maxIter"] <= 1200 and 0.01 <= p["stepSize"] <= 0.3 for kind, p in space.values() if kind == "boosted")
    assert all(0.01 <= p["regParam"] <= 1e4 for kind, p in space.values() if kind == "logistic")
    # The leaderboard holds what single fits give.
    small = L.scaled_down(space, 2)
    board = {r["run"]: r["pr_auc"] for r in L.tournament(df, df, small, ["amount", "noise"], [], "y", parallelism=3).collect()}
    assert set(board) == set(small)
    for name in ("draw_0", "draw_1", "draw_2"):
        kind, params = small[name]
        single = L.scored_by(L.train(df, kind, ["amount", "noise"], [], "y", **params), df)
        # Trees draw their rows by partition, and the trials' rows were written and read.
        assert abs(board[name] - E.average_precision(single, "p", "y").first()[0]) < (1e-6 if kind == "logistic" else 0.01)


def test_kept_model(spark, tmp_path):
    """A loaded model scores as the fitted one, aligned to its own columns; versions that broke off aren't loaded."""
    from riskweave.operators import learning as L

    rng = random.Random(3)
    rows = [(i, int(x > 0.6), x, rng.random(), "ab"[i % 2]) for i, x in enumerate(rng.random() for _ in range(300))]
    df = spark.createDataFrame(rows, "id long, y int, amount double, noise double, kind string")
    kept, folder = L.kept_model(df, df, "logistic", ["amount", "noise"], ["kind"], "y", version=4, maxIter=20), str(tmp_path / "models")
    kept.save(folder)
    kept.model.write().save(f"{folder}/version=9/pipeline")  # broke off
    loaded = L.KeptModel.load(spark, folder)
    assert (loaded.version, loaded.threshold, loaded.numeric, loaded.categories) == (4, kept.threshold, ["amount", "noise"], ["kind"])
    of = lambda d: {r["id"]: (r["p"], r["flagged"]) for r in d.collect()}
    assert of(loaded.score(df)) == of(kept.score(df))
    assert {i for i, (_, f) in of(loaded.score(df)).items() if f} == {i for i, (p, _) in of(loaded.score(df)).items() if p >= kept.threshold}
    # An absent number is 0, an absent category is unknown, other columns don't matter.
    bare = of(loaded.score(df.drop("noise", "kind").withColumn("other", F.lit("x"))))
    assert bare == of(loaded.score(df.withColumns({"noise": F.lit(0.0), "kind": F.lit(None).cast("string")})))


def test_refresh_equals_full_propagation(spark, tmp_path):
    """By the kept projection: an unchanged graph leaves the store as it is; after a change the refreshed rows are those of the whole graph, the others stay."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id long, features array<double>")
    # A hub, so that the caps matter; an edge from a sender that has no row.
    edges = spark.createDataFrame([(i, (i + 1) % 60) for i in range(60)] + [(i, 5) for i in range(10, 50)] + [(99, 6)], "src long, dst long")
    folder = str(tmp_path / "projections")
    store = G.propagated_embeddings(edges, nodes, 4, projections=folder)
    model = G.load_projection(spark, folder)
    active = spark.createDataFrame([(4,)], "id long")
    near = {r["id"] for r in G.neighbourhood(edges, active, 2).collect()}
    of = lambda df: {r["id"]: np.array(r["embedding"]) for r in df.collect()}
    old, same = of(store), of(G.embedding_refresh(edges, nodes, store, active, model))
    assert set(same) == set(old) and 4 in near and len(near) < 60
    assert all(np.allclose(same[i], old[i], atol=1e-9) for i in old)
    changed = spark.createDataFrame([(i, [9.0, 9.0, 9.0] if i == 4 else x) for i, x in rows], "id long, features array<double>")
    new, whole = of(G.embedding_refresh(edges, changed, store, active, model)), of(G.projected(model, G.hop_features(edges, changed)))
    assert all(np.allclose(new[i], whole[i] if i in near else old[i], atol=1e-9) for i in old)
    assert not np.allclose(new[4], old[4]) and not np.allclose(new[6], old[6])
    G.save_projection(model, folder, 3)
    assert G.newest_version(spark, folder) == 3 and G.load_projection(spark, folder).pc == model.pc


def test_components_of_hop_features(spark):
    """Principal components: the covariance of the embedding holds the largest eigenvalues of that of the features."""
    import numpy as np

    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "id long, features array<double>")
    edges = spark.createDataFrame([(i, int(j)) for i in range(60) for j in rng.integers(0, 60, 2)], "src long, dst long")
    x = np.array([r["x"] for r in G.hop_features(edges, nodes).orderBy("id").collect()])
    y = np.array([r["embedding"] for r in G.propagated_embeddings(edges, nodes, 4).orderBy("id").collect()])
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.cov(y.T))), np.sort(np.linalg.eigvalsh(np.cov(x.T)))[-4:])


def test_weights(spark):
    one = spark.createDataFrame([(1,)] * 5, "is_fraud int")
    assert A.class_weights(one).first()["weight"] == 0.0
    none = spark.createDataFrame([(0,)] * 5, "is_fraud int")
    assert A.class_weights(none).first()["weight"] is None
    base = spark.createDataFrame([(1,)] + [(0,)] * 199, "is_fraud int")
    assert {r["sample_weight"] for r in A.rate_corrected(base).collect()} == {1.0}


def test_neighbour_cap_before_the_shuffle(spark):
    """A hub's edges are cut to the cap in every task, before they are shuffled."""
    edges = spark.createDataFrame([(i, 1) for i in range(500)] + [(1, 2)], "src long, dst long")
    plan = G.capped_edges(edges, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning(dst") < plan.index("Partial")
    assert plan.count("WindowGroupLimit") == 2
    got = sorted(r["src"] for r in G.capped_edges(edges, 10).where("dst = 1").collect())
    assert got == sorted(sorted(range(500), key=lambda s: (s * 7919 % 10_007, s))[:10])


def test_broadcasts_are_checked_in_bytes(spark):
    few = spark.createDataFrame([(i, [1.0] * 4) for i in range(10)], "id long, v array<double>")
    assert J.is_small(few) and not J.is_small(few, rows=9) and not J.is_small(few, size=400)
    long = spark.createDataFrame([("x" * 1000,)], "t string")
    assert J.is_small(long) and not J.is_small(long, size=1000)


def test_temporal_split(spark):
    from riskweave.operators.ordering import temporal_split

    rows = [(i, None if i % 10 == 0 else (i * 7) % 13) for i in range(50)]
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    want = {i: "train" if n < 40 else "val" if n < 45 else "test" for n, (i, _) in enumerate(order)}
    assert {r["id"]: r["split"] for r in temporal_split(spark.createDataFrame(rows, "id long, t long"), "t", "id").collect()} == want
    assert temporal_split(spark.createDataFrame([], "id long, t long"), "t", "id").count() == 0
    one = spark.createDataFrame([(1, 5)], "id long, t long")
    assert [r["split"] for r in temporal_split(one, "t", "id").collect()] == ["val" if int(0.9 + 1e-9) else "test"]


def test_linear_model_values(spark):
    """Coefficients are those of the penalised likelihood, worked out apart; with class weights too; the importance is their size; l1 leaves out what l2 keeps."""
    import numpy as np

    from riskweave.operators import learning as L

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.2] + [0, 3, 1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    weight = np.where(y == 1, 3.0, 1.0)
    df = spark.createDataFrame([(i, int(b), *map(float, a), float(w)) for i, (a, b, w) in enumerate(zip(x, y, weight))], "id long, y int, a double, b double, c double, w double")
    z = (x - x.mean(0)) / x.std(0, ddof=1)

    def newton(ridge, w):
        """Mean weighted loss and ridge/2 times the squares; MLlib scales by the deviation of the rows (weighted) once more."""
        dev = np.sqrt(np.average((z - np.average(z, axis=0, weights=w)) ** 2, axis=0, weights=w) * w.sum() / (w.sum() - 1))
        s = np.hstack([z / dev, np.ones((len(z), 1))])
        b, r = np.zeros(4), np.diag([ridge] * 3 + [0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-s @ b))
            b -= np.linalg.solve((s * (w * p * (1 - p))[:, None]).T @ s / w.sum() + r, s.T @ (w * (p - y)) / w.sum() + r @ b)
        return 1 / (1 + np.exp(-s @ b)), b[:3] / dev

    for column, w in ((None, np.ones(400)), ("w", weight)):
        m = L.train(df, "logistic", ["a", "b", "c"], [], "y", weight=column, regParam=0.05, maxIter=200, tol=1e-10)
        want, coefficients = newton(0.05, w)
        got = np.array([r["p"] for r in L.scored_by(m, df).orderBy("id").collect()])
        assert np.abs(got - want).max() < 2e-4
        shown = {r["feature"]: r["importance"] for r in L.importance(m, df).collect()}
        assert np.allclose([shown[c] for c in "abc"], np.abs(coefficients), atol=2e-3)
    lasso = L.train(df, "logistic", ["a", "b", "c"], [], "y", regParam=0.1, elasticNetParam=1.0, maxIter=200).stages[-1].coefficients.toArray()
    ridge = L.train(df, "logistic", ["a", "b", "c"], [], "y", regParam=0.1, elasticNetParam=0.0, maxIter=200).stages[-1].coefficients.toArray()
    assert lasso[2] == 0 and ridge[2] != 0 and lasso[1] < 0


def test_boosted_split_is_the_best_one(spark):
    """The first tree of depth 1 parts the rows where the squared error of the labels is least."""
    from riskweave.operators import learning as L

    rng = random.Random(6)
    rows = [(i, float(i % 32), rng.random()) for i in range(320)]
    rows = [(i, int((a >= 20) != (i % 11 == 0)), a, b) for i, a, b in rows]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    m = L.train(df, "boosted", ["a", "b"], [], "y", maxIter=1, maxDepth=1)
    low = {r["p"] for r in L.scored_by(m, df).where("a < 20").collect()}
    high = {r["p"] for r in L.scored_by(m, df).where("a >= 20").collect()}
    assert len(low) == len(high) == 1 and low < high or min(low) < min(high)
    assert L.importance(m, df).first()["feature"] == "a"


def test_saved_tables_can_be_removed(spark):
    import os

    from riskweave.sources import storage as S

    S.clear_saved(spark)
    kept = S.saved(spark.range(3), "three")
    where = kept.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert os.path.exists(where) and S.clear_saved(spark) == 1 and not os.path.exists(where) and S.clear_saved(spark) == 0


def test_refresh_counts_small_moves(spark, tmp_path):
    """Rows that move by less than a millionth are moved all the same (features of about 10^-6)."""
    import duckdb

    from riskweave.plans import ORACLE_SQL, relations

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    e.withColumn("embedding", F.transform("embedding", lambda x: (x * 1e-5).cast("float"))).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["g15_incremental_refresh"]).fetchall()
    got = [tuple(r) for r in relations.refresh_report(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_order_edges_keep_their_partitions(spark):
    """The join of lines and orders keeps its number of partitions, as Spark would merge well compressed ones; node roles are met by hash, without a sort of all edges."""
    from riskweave.sources import bindings as B
    from riskweave.sources import storage as S

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    edges = B.edges_order(spark, "/root/testdata/sf0.001")
    assert plan(edges).count("REPARTITION_BY_NUM") == 2 and plan(edges).count("Exchange") == 2
    assert "SortAggregate" not in plan(S.graph_nodes(edges))
    few = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "a")], "src string, dst string")
    assert sorted(map(tuple, S.graph_nodes(few).collect()), key=str) == sorted([("a", "sender", "Identity"), ("b", "sender", "Identity"), ("c", "receiver", "Identity"), (None, "sender", "Identity")], key=str)
