"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contained_items

    return contained_items(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("rid")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode_decode

    return encode_decode(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), shingle_words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_docs(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import document_files, licence_scan

    return licence_scan(document_files(_docs(spark, sf_dir)), closing=True).withColumnRenamed("file_id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_docs(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(_docs(spark, sf_dir))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_near_dup": op5_near_dup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_secret_scan": op13_secret_scan,
}

#: Words and shingles as operator 2 has them; {share} is exact in whole numbers.
_OP2 = r"""
WITH d AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents
), b AS (
  SELECT item_id, [w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM i),
g AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[p : p + width - 1], ' ') AS s
  FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS p FROM d, widths WHERE len(w) >= width)
), f AS (SELECT doc_id, item_id, count(*) AS n_found FROM g JOIN i USING (width, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, n_found::INTEGER AS n_found, n_found::DOUBLE / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE 5 * n_found >= 4 * n_shingles
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string in DuckDB, which has no function for it: byte by byte, bit by bit."""
    bits = "list_reduce(list_concat([xor(a, b)], [0::BIGINT FOR i IN range(8)]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], [ord(s)::BIGINT FOR s IN string_split({text}, '')]), lambda a, b: {bits}), 4294967295)"


def _merkle_sql(depth: int = 8) -> str:
    """Operator 12 for up to 16^depth rows: each level as a table of its own."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*(value(c) for c in ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS used FROM documents)",
        "s AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d))",
        "l0 AS MATERIALIZED (SELECT tree, doc_id, leaf, used, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)",
        "a0 AS MATERIALIZED (SELECT tree, pos, n, leaf AS h FROM l0)",
    ]

    def tree(name: str) -> None:
        for k in range(1, depth + 1):
            below = f"{name}{k - 1}"
            steps.append(f"{name}{k} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {below} WHERE n > 1 GROUP BY tree, pos // 16, n)")

    tree("a")
    steps.append("b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM (" + " UNION ALL ".join(f"SELECT tree, h FROM a{k} WHERE n = 1" for k in range(depth + 1)) + "))")
    tree("b")
    steps.append("r AS (SELECT h AS root FROM (" + " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n = 1" for k in range(depth + 1)) + "))")
    # Every leaf climbs: what stands left and right of its node, and the digest folded so far.
    steps.append("c0 AS MATERIALIZED (SELECT row_number() OVER () AS id, tree, pos, n, used AS h, '' AS proof FROM l0)")
    steps.append("e AS MATERIALIZED (SELECT id, doc_id, l.leaf, c.tree FROM c0 c JOIN l0 l USING (tree, pos))")
    last = "c0"

    def climb(name: str, part: str, own: str, where: str) -> None:
        steps.append(
            f"{name} AS MATERIALIZED (SELECT c.id, c.tree, CASE WHEN c.n > 1 THEN c.pos // 16 ELSE c.pos END AS pos, CASE WHEN c.n > 1 THEN (c.n + 15) // 16 ELSE 1 END AS n, "
            f"CASE WHEN c.n > 1 THEN sha256(coalesce(x.low, '') || c.h || coalesce(x.high, '')) ELSE c.h END AS h, c.proof || coalesce(x.low, '') || coalesce(x.high, '') AS proof "
            f"FROM {own} c LEFT JOIN (SELECT id, string_agg(m.h, '' ORDER BY m.pos) FILTER (m.pos < c.pos) AS low, string_agg(m.h, '' ORDER BY m.pos) FILTER (m.pos > c.pos) AS high "
            f"FROM {own} c JOIN {part} m ON {where} AND m.pos // 16 = c.pos // 16 AND c.n > 1 GROUP BY id) x USING (id))"
        )

    for k in range(depth):
        climb(f"c{k + 1}", f"a{k}", f"c{k}", "m.tree = c.tree")
        last = f"c{k + 1}"
    steps.append(f"u AS MATERIALIZED (SELECT a.tree, a.h AS subroot FROM ({' UNION ALL '.join(f'SELECT tree, h, n FROM a{k}' for k in range(depth + 1))}) a WHERE a.n = 1)")
    steps.append(f"t0 AS MATERIALIZED (SELECT id, tree, tree AS pos, (SELECT count(*) FROM s) AS n, h, proof FROM {last})")
    for k in range(depth):
        climb(f"t{k + 1}", f"b{k}", f"t{k}", "TRUE")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT e.doc_id, e.leaf, u.subroot, r.root, sha256(t.proof) AS proof_sha256, t.h AS folded_root, t.h = r.root AS verified FROM e JOIN t{depth} t USING (id) JOIN u ON u.tree = e.tree, r"
    )


#: Prefixes as lists of turn numbers, each node with all of its prefixes.
_OP11 = rf"""
WITH v AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS dig, dense_rank() OVER (ORDER BY role, text) AS sid, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM v
), w AS (SELECT sid, any_value(w) AS w FROM k GROUP BY sid),
o AS (SELECT conv_id, list(sid ORDER BY turn NULLS FIRST, dig) AS own FROM k GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 20 AS family, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM o),
r AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(f.own, [])[1 : h.h], h.own[h.h + 1 :]) AS seq FROM h LEFT JOIN o f ON f.conv_id = h.family),
m AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r),
n AS MATERIALIZED (
  SELECT seq[1 : depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = depth), '') AS ends FROM m GROUP BY 1, 2
), c AS MATERIALIZED (SELECT p[1 : depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
x AS MATERIALIZED (SELECT n.p, n.depth, n.conv_id, n.n_convs, n.ends, coalesce(c.n_children, 0) AS n_children, (n.n_convs - 1) * coalesce(w.w, 0) AS own FROM n LEFT JOIN c USING (p) LEFT JOIN w ON w.sid = n.p[n.depth]),
s AS (SELECT p[1 : d] AS p, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT p, own, n_children, unnest(range(0, depth + 1)) AS d FROM x) GROUP BY 1)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN s USING (p) LEFT JOIN n u ON x.depth > 0 AND u.p = x.p[1 : x.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": _OP11,
    "op12_merkle_manifest": _merkle_sql(),
    "op2_decontamination": _OP2,
    "op1_top_k": """
WITH vectors AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
