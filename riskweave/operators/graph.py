"""Graph operators over edge tables: upserts, paths, neighbourhoods, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import newest_version, saved
from .ordering import ranks


def transaction_edges(df: DataFrame, sender: tuple[str, ...], receiver: tuple[str, ...]) -> DataFrame:
    """Edges of rows that name both ends: first non-empty sender and receiver column."""
    pick = lambda cols: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols))
    return df.withColumns({"src": pick(sender), "dst": pick(receiver)}).where("src IS NOT NULL AND dst IS NOT NULL")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def node_list(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def node_totals(edges: DataFrame, exact: bool = False) -> DataFrame:
    """First and last time, transactions and volume of every node, both ends counted. ``exact``: the volume as a decimal, to be added to."""
    both = edges.select(F.col("src").alias("id"), "amount", "ts_us").unionByName(edges.select(F.col("dst").alias("id"), "amount", "ts_us"))
    volume = F.sum(F.col("amount").cast("decimal(18,4)"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("txn_count"), (volume if exact else F.round(volume.cast("double"), 2)).alias("total_volume"), F.min("ts_us").alias("first_seen"), F.max("ts_us").alias("last_seen"))


def upsert_nodes(nodes: DataFrame, delta: DataFrame) -> DataFrame:
    """Old totals and a batch's totals as one table; volumes keep their type."""
    kind = nodes.schema["total_volume"].dataType
    o, d = nodes.alias("o"), delta.alias("d")
    both = o.join(d, F.col("o.id") == F.col("d.id"), "full")
    add = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"d.{c}"), F.lit(0))
    return both.select(
        F.coalesce("o.id", "d.id").alias("id"), add("txn_count").alias("txn_count"), (F.round(add("total_volume"), 2) if kind.typeName() == "double" else add("total_volume").cast(kind)).alias("total_volume"),
        F.least("o.first_seen", "d.first_seen").alias("first_seen"), F.greatest("o.last_seen", "d.last_seen").alias("last_seen"),
    )


def mule_hubs(edges: DataFrame, least: int = 5, limit: int = 20) -> DataFrame:
    """Receivers of at least so many fraud edges, most first (a report of ``limit`` rows)."""
    n = edges.where("is_fraud = 1").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fraud_in"))
    return n.where(F.col("fraud_in") >= least).orderBy(F.desc("fraud_in"), "id").limit(limit)


def cross_modal_groups(edges: DataFrame, key: str) -> DataFrame:
    """Groups with several modalities: their modalities, span and amounts."""
    g = edges.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("modalities"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.countDistinct("amount").alias("amounts"))
    return g.where(F.col("modalities").contains(","))


def dual_modality(edges: DataFrame) -> DataFrame:
    """Senders active in both modalities."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.max(F.col("modality") == "fiat").alias("f"), F.max(F.col("modality") == "crypto").alias("c")).where("f AND c").select("id")


def ring(edges: DataFrame, network: int) -> DataFrame:
    """Edges of one network."""
    return edges.where(F.col("network") == network)


def distances(edges: DataFrame, sources: DataFrame, hops: int = 5) -> DataFrame:
    """``id, distance`` of all nodes within ``hops`` undirected steps of a source.

    Breadth first from all sources at once: each round joins the frontier with
    the edges and leaves out visited nodes. Rounds are written tables, so their
    lineage stays short and a lost executor repeats one round at most.
    """
    both = saved(undirected(edges).where("src <> dst").distinct(), "bfs-edges")
    seen = saved(sources.select("id").distinct().withColumn("distance", F.lit(0)), "bfs-0")
    frontier = seen
    for hop in range(1, hops + 1):
        step = both.hint("merge").join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = saved(step.hint("merge").join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)), f"bfs-{hop}")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def active_nodes(nodes: DataFrame, now_us: Column, seconds: int = 120, limit: int = 5000) -> DataFrame:
    return nodes.where(F.col("last_seen") >= now_us - seconds * 1_000_000).orderBy(F.desc("last_seen"), "id").limit(limit)


def neighbourhood(edges: DataFrame, active: DataFrame, hops: int = 2) -> DataFrame:
    return distances(edges, active, hops).select("id")


def max_normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    top = df.agg(*(F.max(c).alias(f"_{c}") for c in columns))
    return df.join(F.broadcast(top)).withColumns({c: F.round(F.col(c) / F.greatest(F.col(f"_{c}"), F.lit(1e-9)), 6) for c in columns}).drop(*(f"_{c}" for c in columns))


def min_max_vectors(nodes: DataFrame) -> DataFrame:
    """``id, dim, x``: every dimension scaled to [0, 1]; 0 where it has one value."""
    d = nodes.select("id", F.posexplode("features").alias("dim", "x"))
    span = d.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # a row for each dimension
    return d.join(F.broadcast(span), "dim").select("id", "dim", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0), 6).alias("x"))


def capped_edges(edges: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` neighbours of a node, the same ones every time.

    The rank is filtered at once, so Spark keeps ``cap`` rows of a node in every
    task before the shuffle (``WindowGroupLimit``, up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``): a hub comes as ``cap``
    rows from each task, never with all its edges. A test reads the plan.
    """
    order = Window.partitionBy("dst").orderBy(F.pmod(F.col("src") * 7919, F.lit(10_007)), "src")
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def neighbour_mean(edges: DataFrame, nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """``id, mean``: mean feature vector of a node's neighbours, summed as vectors in the JVM."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    e = edges if cap is None else capped_edges(edges, cap)
    both = e.hint("merge").join(nodes.select(F.col("id").alias("src"), array_to_vector("features").alias("v")), "src")
    return both.groupBy(F.col("dst").alias("id")).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))


def hop_features(edges: DataFrame, nodes: DataFrame, caps: tuple[int, int] = (15, 10)) -> DataFrame:
    """``id, x``: a node's vector, its neighbours' mean and the mean of these, end to end; zeros where it has no neighbours."""
    zeros = lambda like: F.transform(like, lambda x: F.lit(0.0))
    one = nodes.hint("merge").join(neighbour_mean(edges, nodes, caps[0]), "id", "left").select("id", "features", F.coalesce("mean", zeros(F.col("features"))).alias("h1"))
    two = neighbour_mean(edges, one.select("id", F.col("h1").alias("features")), caps[1])
    return one.hint("merge").join(two, "id", "left").select("id", F.concat("features", "h1", F.coalesce("mean", zeros(F.col("features")))).alias("x"))


def fit_projection(hops: DataFrame, size: int):
    """The principal components of hop features (``id, x``), as a model that maps any later row the same way."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    return PCA(k=size, inputCol="x", outputCol="y").fit(hops.select("id", array_to_vector("x").alias("x")))


def projected(model, hops: DataFrame) -> DataFrame:
    """``id, embedding``: hop features mapped by a fitted projection."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    return model.transform(hops.select("id", array_to_vector("x").alias("x"))).select("id", vector_to_array("y").alias("embedding"))


def save_projection(model, folder: str, version: int) -> None:
    """Keep a projection as version ``version`` of ``folder``. A version is written once; readers of older ones aren't disturbed."""
    model.write().save(f"{folder}/version={version}")


def load_projection(spark, folder: str, version: int | None = None):
    """A kept projection, by default the newest."""
    from pyspark.ml.feature import PCAModel

    return PCAModel.load(f"{folder}/version={newest_version(spark, folder) if version is None else version}")


def propagated_embeddings(edges: DataFrame, nodes: DataFrame, size: int = 32, caps: tuple[int, int] = (15, 10), projections: str | None = None, version: int = 1) -> DataFrame:
    """``hop_features`` reduced by principal components to ``size``. Written before the fit, which reads them several times.

    With ``projections``, a folder, the fitted components are kept there, so that
    ``embedding_refresh`` maps later rows to the same coordinates.
    """
    hops = saved(hop_features(edges, nodes, caps), "hops")
    model = fit_projection(hops, size)
    if projections is not None:
        save_projection(model, projections, version)
    return projected(model, hops)


def hop_features_of(edges: DataFrame, nodes: DataFrame, some: DataFrame, caps: tuple[int, int] = (15, 10)) -> DataFrame:
    """``hop_features`` of the nodes in ``some`` (``id``), equal to those of the whole graph.

    Two steps reach their neighbours' neighbours, so these (the halo) come along:
    every edge into ``some`` and into the senders of these edges, whole, as the cap
    on neighbours has to see all of a node's. The work follows that part.
    """
    into = lambda ids: edges.hint("merge").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    wanted = saved(some.select("id").distinct(), "wanted")
    inner = saved(wanted.unionByName(into(wanted).select(F.col("src").alias("id"))).distinct(), "inner")
    part = saved(into(inner).select("src", "dst"), "halo-edges")
    outer = inner.unionByName(part.select(F.col("src").alias("id"))).distinct()
    around = saved(nodes.select("id", "features").hint("merge").join(outer, "id", "left_semi"), "halo-nodes")
    return hop_features(part, around, caps).hint("merge").join(wanted, "id", "left_semi")


def embedding_refresh(edges: DataFrame, nodes: DataFrame, store: DataFrame, active: DataFrame, model, hops: int = 2, caps: tuple[int, int] = (15, 10)) -> DataFrame:
    """The store with new embeddings of the neighbourhood of the ``active`` nodes, by a kept projection.

    Nothing is fitted: new rows lie in the coordinates of the store, and a refresh
    of an unchanged graph changes nothing.
    """
    near = saved(neighbourhood(edges, active, hops), "near")
    return refreshed(store, projected(model, hop_features_of(edges, nodes, near, caps)))


def combined_graphs(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Nodes of two graphs in one table: a namespace, vectors of one length, labels of the first only."""
    from ..functions.records import padded

    one = a.select(F.lit("a").alias("namespace"), F.col("id").cast("string").alias("id"), padded(F.col("features"), size).alias("features"), "label")
    two = b.select(F.lit("b").alias("namespace"), F.col("id").cast("string").alias("id"), padded(F.col("features"), size).alias("features"), F.lit(None).cast("int").alias("label"))
    return one.unionByName(two)


def refreshed(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the rows of ``new`` in place of those with the same id."""
    return store.hint("merge").join(new.select("id"), "id", "left_anti").unionByName(new)


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """0, 1, 2, ... by key."""
    return ranks(df, [], [F.col(key)], "index").drop("_n")
