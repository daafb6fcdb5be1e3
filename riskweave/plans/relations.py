"""Queries: joins, sets, graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.decisions import label_weight
from ..operators import graph as G
from ..operators import joins as J
from ..operators.aggregates import newest_us
from ..sources import bindings as B
from ..sources import storage as S
from .catalog import query

M = "::DECIMAL(18,4)"
_W = "(CASE WHEN confidence >= 0.85 THEN 1.0 WHEN confidence >= 0.70 THEN 0.7 ELSE 0.4 END)::DOUBLE"


@query("io6_graph_export_nodes", f"""WITH {B.EDGES_ORDER}, r AS (SELECT src AS id, 'a_sender' AS role FROM edges UNION ALL SELECT dst, 'b_receiver' FROM edges)
SELECT id AS "hash:ID", substr(min(role), 3) AS archetype, 'Identity' AS ":LABEL" FROM r GROUP BY id""")
def io6(spark, d):
    return S.graph_nodes(B.edges_order(spark, d))


@query("io6_graph_export_edges", f"""WITH {B.EDGES_ORDER} SELECT src AS ":START_ID", dst AS ":END_ID", 'SENT_TO' AS ":TYPE", amount AS "amount_usd:double", is_fraud = 1 AS "is_fraud:boolean" FROM edges""")
def io6e(spark, d):
    return S.graph_edges(B.edges_order(spark, d))


_MOVES = "SELECT sha256('0xa' || identity) AS sender, sha256('0xb' || receiver) AS receiver, amount_usd * 2800 AS usd, transaction_id, date_trunc('second', ts) AS ts FROM txn WHERE event_id % 50 <> 0"


@query("io9_transfer_rows", f"WITH {B.TXN} SELECT transaction_id, epoch_us(ts) AS ts_us, sender AS sender_wallet_hash, receiver AS receiver_wallet_hash, round(usd, 4) AS amount_usd, 'ETH' AS cryptocurrency, 'crypto' AS modality, 1 AS is_fraud, 'alchemy_tornado_cash' AS source FROM ({_MOVES})")
def io9(spark, d):
    good, _ = S.parsed_transfers(_transfers(spark, d))
    rows = S.transfer_rows(good, "tornado_cash")
    return rows.withColumns({"ts_us": F.unix_micros("timestamp"), "amount_usd": F.round("amount_usd", 4)}).drop("timestamp")


@query("io10_transfer_edges", f"WITH {B.TXN} SELECT sender AS src, receiver AS dst, round(usd, 4) AS amount, transaction_id, 1 AS depth, true AS fraud_proximity FROM ({_MOVES})")
def io10(spark, d):
    good, _ = S.parsed_transfers(_transfers(spark, d))
    return S.transfer_edges(good, 1, True).withColumn("amount", F.round("amount", 4))


_EVENTS = "SELECT event_id, user_id, event_type, value, props FROM events"


def _round_trip(spark, d, write, read):
    """Every event written by one function and read by another."""
    path = f"{S.shared_folder(spark)}/io-{uuid.uuid4().hex}"
    e = B.table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    write(e, path)
    return read(path, "event_id long, user_id long, event_type string, value double, props string")


@query("io2_json_lines", _EVENTS)
def io2(spark, d):
    return _round_trip(spark, d, lambda e, p: e.write.json(p), lambda p, schema: S.read_json_lines(spark, p, schema))


@query("io3_io5_csv_with_header", _EVENTS)
def io3(spark, d):
    return _round_trip(spark, d, S.write_csv, lambda p, schema: S.read_csv(spark, p, schema))


@query("io3_csv_without_header", _EVENTS)
def io3b(spark, d):
    return _round_trip(spark, d, lambda e, p: S.write_csv(e, p, header=False), lambda p, schema: S.read_csv(spark, p, schema, header=False))


@query("io4_split_folders", "SELECT event_id, user_id, event_type, value, props, CASE WHEN event_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM events")
def io4(spark, d):
    split = F.when(F.col("event_id") % 10 < 8, "train").otherwise("test")
    return _round_trip(spark, d, lambda e, p: S.write_splits(e.withColumn("split", split), p), lambda p, schema: spark.read.schema(f"{schema}, split string").parquet(p))


def _transfers(spark, d):
    t = B.txn(spark, d)
    ts = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("blockTimestamp"))
    line = F.to_json(F.struct(F.concat(F.lit("0xA"), F.col("identity").cast("string")).alias("from"), F.concat(F.lit("0xB"), F.col("receiver").cast("string")).alias("to"), F.col("amount_usd").alias("value"), F.lit("ETH").alias("asset"), F.col("transaction_id").alias("hash"), ts.alias("metadata")))
    return t.select(F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(line).alias("json"))


@query("io7_dead_letters", f"WITH {B.TXN} SELECT count(*) AS n FROM txn WHERE event_id % 50 = 0")
def io7(spark, d):
    return S.parsed_transfers(_transfers(spark, d))[1].agg(F.count(F.lit(1)).alias("n"))


@query("j1_embedding_lookup", f"""WITH {B.TXN} SELECT t.event_id, (v.vec_id IS NOT NULL)::INTEGER AS embedding_hit, round(coalesce(v.embedding[1]::DOUBLE, 0), 6) AS first FROM txn t LEFT JOIN embeddings v ON t.event_id % 700 = v.vec_id""")
def j1(spark, d):
    t = B.txn(spark, d).withColumn("node", F.col("event_id") % 700)
    return J.with_embedding(t, B.nodes_vec(spark, d), "node", 64).select("event_id", "embedding_hit", F.round(F.col("embedding")[0], 6).alias("first"))


@query("j1_embedding_coverage", f"""WITH {B.TXN} SELECT count(*) AS n, count(v.vec_id) AS hits, round(count(v.vec_id) / count(*), 6) AS hit_rate, count(v.vec_id) / count(*) < 0.1 AS warning FROM txn t LEFT JOIN embeddings v ON t.event_id % 700 = v.vec_id""")
def j1c(spark, d):
    t = B.txn(spark, d).withColumn("node", F.col("event_id") % 700)
    return J.coverage(J.with_embedding(t, B.nodes_vec(spark, d), "node", 64))


@query("j2_features_with_classes", f"WITH {B.NODES_VEC} SELECT id, round(features[1], 6) AS first, CASE WHEN id % 3 <> 0 THEN class END AS class FROM nodes")
def j2(spark, d):
    n = B.nodes_vec(spark, d)
    return J.features_with_classes(n.select("id", "features"), n.where("id % 3 <> 0").select("id", "class")).select("id", F.round(F.col("features")[0], 6).alias("first"), "class")


@query("j3_review_candidates", f"""WITH {B.SCORED}, {B.LABELS} SELECT s.transaction_id, round(s.risk_score, 6) AS risk_score FROM scored s, latest
WHERE decision = 'review' AND ts_us >= now - 240 * 3600000000 AND amount_usd < 80 AND NOT EXISTS (SELECT 1 FROM labels_tbl l WHERE l.transaction_id = s.transaction_id) ORDER BY s.risk_score DESC, s.transaction_id LIMIT 500""")
def j3(spark, d):
    s = B.scored(spark, d)
    return J.review_candidates(s, B.labels_tbl(spark, d), B.at(newest_us(s) - 240 * 3_600_000_000), below=80.0).select("transaction_id", F.round("risk_score", 6).alias("risk_score"))


@query("j4_insert_absent", f"""WITH {B.TXN}, {B.LABELS} SELECT transaction_id, source FROM labels_tbl UNION ALL SELECT transaction_id, 'new' FROM txn WHERE event_id % 3 = 0 AND event_id % 5 <> 0""")
def j4(spark, d):
    new = B.txn(spark, d).where("event_id % 3 = 0").select("transaction_id", F.lit("new").alias("source"))
    return J.insert_absent(B.labels_tbl(spark, d).select("transaction_id", "source"), new.unionByName(new), "source")


@query("j5_chargebacks", f"""WITH {B.TXN}, {B.LABELS}, l AS (SELECT transaction_id, event_id, source, {_W} AS weight, chargeback_label FROM labels_tbl)
SELECT transaction_id, CASE WHEN chargeback_label IS NULL AND event_id % 4 = 0 THEN 'chargeback' ELSE source END AS source, CASE WHEN chargeback_label IS NULL AND event_id % 4 = 0 THEN 1.0 ELSE weight END AS weight,
  coalesce(chargeback_label, CASE WHEN event_id % 4 = 0 THEN 1 END) AS chargeback_label FROM l""")
def j5(spark, d):
    labels = B.labels_tbl(spark, d).withColumn("weight", label_weight(F.col("confidence"))).select("transaction_id", "source", "weight", "chargeback_label")
    return J.apply_chargebacks(labels, B.txn(spark, d).where("event_id % 4 = 0").select("transaction_id", F.lit(1).alias("is_fraud")))


@query("j6_evaluation_rows", f"""WITH {B.TXN}, {B.LABELS} SELECT l.transaction_id, round(risk_score, 6) AS risk_score, coalesce(chargeback_label, llm_label) AS label FROM labels_tbl l JOIN txn USING (transaction_id) WHERE (chargeback_label IS NOT NULL OR confidence >= 0.80) AND (SELECT count(*) FROM labels_tbl WHERE chargeback_label IS NOT NULL OR confidence >= 0.80) >= 50""")
def j6(spark, d):
    return J.evaluation_rows(B.scored(spark, d), B.labels_tbl(spark, d)).select("transaction_id", F.round("risk_score", 6).alias("risk_score"), "label")


@query("j7_recycled_receiver", f"""WITH {B.EDGES_TXN}, b AS (SELECT src AS id FROM edges WHERE modality = 'crypto' AND client_id = 'cryptoex' INTERSECT SELECT dst FROM edges WHERE modality = 'crypto' AND client_id = 'cryptoex')
SELECT edge_id, (dst IN (SELECT id FROM b))::INTEGER AS recycled FROM edges""")
def j7(spark, d):
    return J.recycled_receiver(B.edges_txn(spark, d), F.expr("modality = 'crypto' AND client_id = 'cryptoex'")).select("edge_id", "recycled")


@query("j8_illicit_neighbours", f"""WITH {B.NODES_VEC}, {B.EDGES_VEC}, u AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
n AS (SELECT src AS id, count(*) AS c FROM u WHERE dst IN (SELECT id FROM nodes WHERE class = '1') GROUP BY src)
SELECT id, coalesce(c, 0) AS illicit_neighbours, (coalesce(c, 0) > 0)::INTEGER AS has_illicit_neighbour FROM nodes LEFT JOIN n USING (id)""")
def j8(spark, d):
    return J.illicit_neighbours(B.nodes_vec(spark, d), B.edges_vec(spark, d)).select("id", "illicit_neighbours", "has_illicit_neighbour")


@query("j9_frontier_expansion", f"""WITH {B.EDGES_TXN}, s AS (SELECT src AS id, max((modality = 'crypto')::INTEGER) AS near FROM edges WHERE is_fraud = 1 GROUP BY src),
n AS (SELECT dst AS id, max(near) AS near_fraud FROM edges JOIN s ON edges.src = s.id WHERE dst NOT IN (SELECT id FROM s) GROUP BY dst)
(SELECT id, near_fraud FROM n WHERE near_fraud = 1 ORDER BY id LIMIT 28) UNION ALL (SELECT id, near_fraud FROM n WHERE near_fraud = 0 ORDER BY id LIMIT 12)""")
def j9(spark, d):
    """From all senders of fraud edges; near fraud if any of these is crypto."""
    e = B.edges_txn(spark, d)
    seeds = e.where("is_fraud = 1").groupBy(F.col("src").alias("id")).agg(F.max((F.col("modality") == "crypto").cast("int")).alias("near_fraud"))
    return J.expand_frontier(e, seeds, 40)


_ACTIVE = "active AS (SELECT DISTINCT id FROM (SELECT src AS id, ts_us FROM edges UNION ALL SELECT dst, ts_us FROM edges) WHERE ts_us >= (SELECT max(ts_us) FROM edges) - 7200000000)"


def _active(e):
    """Nodes of the edges of the last two hours."""
    return G.node_list(e.where(F.col("ts_us") >= newest_us(e) - 7_200_000_000))


@query("j10_active_subgraph", f"WITH {B.EDGES_TXN}, {_ACTIVE} SELECT edge_id FROM edges WHERE src IN (SELECT id FROM active) OR dst IN (SELECT id FROM active)")
def j10(spark, d):
    e = B.edges_txn(spark, d)
    return J.active_subgraph(e, _active(e)).select("edge_id")


@query("j11_wallet_conflicts", f"WITH {B.EDGES_TXN} SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT dst FROM edges WHERE is_fraud = 1) ORDER BY id LIMIT 2000")
def j11(spark, d):
    e = B.edges_txn(spark, d)
    return J.resolve_wallets(e.select(F.col("src").alias("id")), e.where("is_fraud = 1").select(F.col("dst").alias("id")))


@query("j12_fiat_crypto_pairs", f"""WITH {B.TXN} SELECT f.identity, f.transaction_id AS fiat_id, c.transaction_id AS crypto_id, round((c.ts_us - f.ts_us) / 1000000::DOUBLE, 3) AS seconds
FROM txn f JOIN txn c ON f.identity = c.identity AND f.modality = 'fiat' AND c.modality = 'crypto' AND c.ts_us BETWEEN f.ts_us AND f.ts_us + 15 * 60000000""")
def j12(spark, d):
    return J.fiat_crypto_pairs(B.txn(spark, d))


@query("k11_undirected", f"WITH {B.EDGES_TXN} SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges")
def k11(spark, d):
    return G.undirected(B.edges_txn(spark, d))


@query("k12_node_list", f"WITH {B.EDGES_ORDER} SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def k12(spark, d):
    return G.node_list(B.edges_order(spark, d))


@query("k13_intersection", f"WITH {B.EDGES_TXN} SELECT src AS id FROM edges WHERE is_fraud = 1 INTERSECT SELECT dst FROM edges WHERE is_fraud = 0")
def k13(spark, d):
    e = B.edges_txn(spark, d)
    return e.where("is_fraud = 1").select(F.col("src").alias("id")).intersect(e.where("is_fraud = 0").select("dst"))


@query("k14_dense_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS \"index\" FROM documents")
def k14(spark, d):
    return G.dense_index(B.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("g1_transaction_edges", "SELECT event_id, user_id::VARCHAR AS src, 'm' || event_type AS dst FROM events WHERE event_id % 7 <> 0")
def g1(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.lit("").alias("identity"), F.col("user_id").cast("string").alias("sender"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("m"), F.col("event_type"))).alias("receiver"), F.lit(None).cast("string").alias("wallet"))
    return G.transaction_edges(e, ("identity", "sender"), ("receiver", "wallet")).select("event_id", "src", "dst")


@query("g1b_export_edges", f"WITH {B.TXN} SELECT event_id, client_id AS src, receiver::VARCHAR AS dst FROM txn")
def g1b(spark, d):
    t = B.txn(spark, d).select("event_id", "client_id", F.col("identity").cast("string").alias("sender"), F.col("receiver").cast("string").alias("receiver"))
    return G.transaction_edges(t, ("client_id", "sender"), ("receiver",)).select("event_id", "src", "dst")


@query("g2_node_upsert", f"""WITH {B.EDGES_TXN}, b AS (SELECT src AS id, amount, ts_us FROM edges UNION ALL SELECT dst, amount, ts_us FROM edges)
SELECT id, count(*) AS txn_count, round(sum(amount{M})::DOUBLE, 2) AS total_volume, min(ts_us) AS first_seen, max(ts_us) AS last_seen FROM b GROUP BY id""")
def g2(spark, d):
    e = B.edges_txn(spark, d)
    return G.upsert_nodes(G.node_totals(e.where("edge_id % 3 <> 0")), G.node_totals(e.where("edge_id % 3 = 0")))


@query("g3_mule_hubs", f"WITH {B.EDGES_ORDER} SELECT dst AS id, count(*) AS fraud_in FROM edges WHERE is_fraud = 1 GROUP BY dst HAVING count(*) >= 5 ORDER BY fraud_in DESC, id LIMIT 20")
def g3(spark, d):
    return G.mule_hubs(B.edges_order(spark, d))


@query("g4_cross_modal_groups", f"""WITH {B.EDGES_ORDER} SELECT network, array_to_string(list_sort(list_distinct(list(modality))), ',') AS modalities, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT amount) AS amounts FROM edges GROUP BY network HAVING count(DISTINCT modality) > 1""")
def g4(spark, d):
    return G.cross_modal_groups(B.edges_order(spark, d), "network")


@query("g5_dual_modality", f"WITH {B.EDGES_TXN} SELECT src AS id FROM edges GROUP BY src HAVING bool_or(modality = 'fiat') AND bool_or(modality = 'crypto')")
def g5(spark, d):
    return G.dual_modality(B.edges_txn(spark, d))


@query("g6_ring", f"WITH {B.EDGES_ORDER} SELECT DISTINCT id FROM (SELECT src AS id FROM edges WHERE network = 7 UNION ALL SELECT dst FROM edges WHERE network = 7)")
def g6(spark, d):
    return G.node_list(G.ring(B.edges_order(spark, d), 7))


_BFS = """WITH RECURSIVE {ctes}, u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst),
walk(id, distance) AS (SELECT id, 0 FROM seeds UNION SELECT u.dst, distance + 1 FROM walk JOIN u ON walk.id = u.src WHERE distance < {hops})
SELECT id, min(distance)::INTEGER AS distance FROM walk GROUP BY id"""


@query("g7_fraud_distance", _BFS.format(ctes=f"{B.NODES_VEC}, {B.EDGES_VEC}, seeds AS (SELECT id FROM nodes WHERE class = '1')", hops=5))
def g7(spark, d):
    return G.distances(B.edges_vec(spark, d), B.nodes_vec(spark, d).where("class = '1'").select("id"))


@query("g8_active_nodes", f"""WITH {B.EDGES_TXN}, b AS (SELECT src AS id, ts_us FROM edges UNION ALL SELECT dst, ts_us FROM edges), n AS (SELECT id, max(ts_us) AS last_seen FROM b GROUP BY id)
SELECT id, last_seen FROM n WHERE last_seen >= (SELECT max(ts_us) FROM edges) - 7200000000 ORDER BY last_seen DESC, id LIMIT 5000""")
def g8(spark, d):
    e = B.edges_txn(spark, d)
    return G.active_nodes(G.node_totals(e), F.lit(newest_us(e)), 7200).select("id", "last_seen")


_LAST_STEP = "seeds AS (SELECT id FROM nodes WHERE step = (SELECT max(step) FROM nodes))"


def _last_step(nodes):
    """Nodes of the newest time step, about one in 49."""
    return nodes.where(F.col("step") == newest_us(nodes, "step")).select("id")


@query("g9_two_hop", "SELECT id FROM (" + _BFS.format(ctes=f"{B.NODES_VEC}, {B.EDGES_VEC}, {_LAST_STEP}", hops=2) + ")")
def g9(spark, d):
    return G.neighbourhood(B.edges_vec(spark, d), _last_step(B.nodes_vec(spark, d)))


@query("g10_max_normalised", f"""WITH {B.EDGES_TXN}, s AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY src) SELECT id, round(n / (SELECT greatest(max(n), 1e-9) FROM s), 6) AS n FROM s""")
def g10(spark, d):
    s = B.edges_txn(spark, d).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return G.max_normalised(s, ["n"])


@query("g11_min_max_vectors", f"""WITH {B.NODES_VEC}, u AS (SELECT id, (generate_subscripts(features, 1) - 1)::INTEGER AS dim, unnest(features) AS x FROM nodes), s AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM u GROUP BY dim)
SELECT id, dim, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 6) AS x FROM u JOIN s USING (dim)""")
def g11(spark, d):
    return G.min_max_vectors(B.nodes_vec(spark, d))


@query("g12_neighbour_mean", f"""WITH {B.NODES_VEC}, {B.EDGES_VEC} SELECT e.dst AS id, round(avg(n.features[1]), 5) AS m0, round(avg(n.features[64]), 5) AS m63 FROM edges e JOIN nodes n ON e.src = n.id GROUP BY e.dst""")
def g12(spark, d):
    return G.neighbour_mean(B.edges_vec(spark, d), B.nodes_vec(spark, d)).select("id", F.round(F.col("mean")[0], 5).alias("m0"), F.round(F.col("mean")[63], 5).alias("m63"))


@query("g12_capped_neighbour_mean", f"""WITH {B.NODES_VEC}, {B.EDGES_VEC}, c AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src * 7919 % 10007, src) AS r FROM edges)
SELECT c.dst AS id, round(avg(n.features[1]), 5) AS m0, round(avg(n.features[64]), 5) AS m63 FROM c JOIN nodes n ON c.src = n.id WHERE r <= 1 GROUP BY c.dst""")
def g12c(spark, d):
    """One neighbour each, so that the cap is met."""
    return G.neighbour_mean(B.edges_vec(spark, d), B.nodes_vec(spark, d), 1).select("id", F.round(F.col("mean")[0], 5).alias("m0"), F.round(F.col("mean")[63], 5).alias("m63"))


@query("g13_hop_features", f"""WITH {B.NODES_VEC}, {B.EDGES_VEC}, c AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src * 7919 % 10007, src) AS r FROM edges),
m AS (SELECT c.dst AS id, avg(n.features[1]) AS h FROM c JOIN nodes n ON c.src = n.id WHERE r <= 15 GROUP BY c.dst), a AS (SELECT id, features[1] AS x, coalesce(h, 0) AS h FROM nodes LEFT JOIN m USING (id)),
t AS (SELECT c.dst AS id, avg(a.h) AS h FROM c JOIN a ON c.src = a.id WHERE r <= 10 GROUP BY c.dst)
SELECT a.id, 192::BIGINT AS size, round(a.x, 5) AS own, round(a.h, 5) AS one_hop, round(coalesce(t.h, 0), 5) AS two_hop FROM a LEFT JOIN t USING (id)""")
def g13h(spark, d):
    x = G.hop_features(B.edges_vec(spark, d), B.nodes_vec(spark, d))
    return x.select("id", F.size("x").cast("long").alias("size"), *(F.round(F.col("x")[i], 5).alias(n) for i, n in ((0, "own"), (64, "one_hop"), (128, "two_hop"))))


@query("g13_propagated_embeddings")
def g13(spark, d):
    return G.propagated_embeddings(B.edges_vec(spark, d), B.nodes_vec(spark, d))


@query("g14_combined_graphs", f"WITH {B.NODES_VEC} SELECT 'a' AS namespace, id::VARCHAR AS id, (class = '1')::INTEGER AS label, 70::BIGINT AS size FROM nodes UNION ALL SELECT 'b', (id + 1)::VARCHAR, NULL, 70 FROM nodes")
def g14(spark, d):
    n = B.nodes_vec(spark, d)
    c = G.combined_graphs(n.withColumn("label", (F.col("class") == "1").cast("int")), n.withColumn("id", F.col("id") + 1), 70)
    return c.select("namespace", "id", "label", F.size("features").cast("long").alias("size"))


#: A node's hop features see its capped neighbours of two steps; ``touched``: those that see a changed node.
_TOUCHED = f"""{B.NODES_VEC}, {B.EDGES_VEC}, seeds AS (SELECT id FROM nodes WHERE step = (SELECT max(step) FROM nodes)),
c AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src * 7919 % 10007, src) AS r FROM edges), known AS (SELECT c.* FROM c JOIN nodes n ON n.id = c.src),
near1 AS (SELECT dst AS id FROM known JOIN seeds ON seeds.id = src WHERE r <= 15),
touched AS (SELECT id FROM seeds UNION SELECT id FROM near1 UNION SELECT dst FROM known JOIN near1 ON near1.id = src WHERE r <= 10)"""


def refresh_report(spark, d, size: int = 16):
    """What a refresh does to the store once the newest step's features have doubled: ``id, refreshed, moved, error``.

    The store and its projection are made from the graph before. ``moved``: the
    row isn't the store's any more; ``error``: its distance from the whole graph
    worked out anew by the kept projection, 0 for refreshed rows.
    """
    folder = f"{S.shared_folder(spark)}/projections-{uuid.uuid4().hex}"
    nodes, edges = B.nodes_vec(spark, d), B.edges_vec(spark, d)
    store = S.saved(G.propagated_embeddings(edges, nodes, size, projections=folder), "store")
    model, active = G.load_projection(spark, folder), _last_step(nodes)
    changed = nodes.withColumn("features", F.when(F.col("step") == newest_us(nodes, "step"), F.transform("features", lambda x: 2 * x)).otherwise(F.col("features")))
    near = G.neighbourhood(edges, active).withColumn("refreshed", F.lit(True))
    new = G.embedding_refresh(edges, changed, store, active, model)
    whole = G.projected(model, G.hop_features(edges, changed))
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: F.greatest(x, y))
    noise = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: F.greatest(x, F.abs(y))) * 1e-12  # noqa: E731  sums in another order
    named = lambda df, name: df.select("id", F.col("embedding").alias(name))
    both = named(new, "new").hint("merge").join(named(store, "old"), "id").join(named(whole, "whole").hint("merge"), "id").join(near.hint("merge"), "id", "left")
    return both.select("id", F.coalesce("refreshed", F.lit(False)).alias("refreshed"), (far("new", "old") > noise(F.col("old"))).alias("moved"), F.when(F.col("refreshed"), F.round(far("new", "whole"), 6)).otherwise(0.0).alias("error"))


@query("g15_incremental_refresh", f"WITH RECURSIVE {_TOUCHED}, u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst), walk(id, distance) AS (SELECT id, 0 FROM seeds UNION SELECT u.dst, distance + 1 FROM walk JOIN u ON walk.id = u.src WHERE distance < 2), w AS (SELECT DISTINCT id FROM walk) SELECT n.id, w.id IS NOT NULL AS refreshed, w.id IS NOT NULL AND t.id IS NOT NULL AS moved, 0.0::DOUBLE AS error FROM nodes n LEFT JOIN w USING (id) LEFT JOIN touched t USING (id)")
def g15(spark, d):
    return refresh_report(spark, d)
