"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, chat, licenses, minhash, packing, pieces, ppm, quality, repair, suffix, syncmers, topk, trie
from .common import materialize

BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(extra)))


def op2_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op4_sentencepiece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES, with_ids=False)


def op5_minhash_oph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80, bands=32, rows=4)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), BPE, capacity=1024, end_id=2)
    return packing.pack(pieces, 1024, ["doc_id", "piece", "ids_crc32"])


def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op8_token_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.read_token_files(bitpack.write_token_files(table(spark, sf_dir, "documents"), BPE, end_id=0))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op10_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), width=200)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.repair_digests(damaged, materialize(repair.repair_plans(damaged), "repair-plans"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("n_matches", F.size("matches").cast("long")).drop("matches")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_prefix_targets": OP1_SQL, "op5_minhash_oph": OP5_SQL, "op9_exact_topk": OP9_SQL, "op10_suffix_intervals": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_structure_repair": OP12_SQL}


OP1_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length('<|im_start|>' || '<|im_end|>') + 2
    + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n'))
    + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  count(CASE WHEN role = 'assistant' THEN 1 END) AS n_examples
FROM e GROUP BY conv_id
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3)) WHEN len(w) > 0 THEN [w] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = d.doc_id
"""

#: Windows are compared by a 64-bit hash here.
OP10_SQL = """
WITH h AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), st AS (
  SELECT r, i, hash(array_slice(x, 2 * i + 1, 2 * i + 400)) AS g FROM h, LATERAL (SELECT unnest(range(0, n - 199)) AS i) WHERE n >= 200
), d AS (
  SELECT g FROM st GROUP BY g HAVING count(*) > 1
), m AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM st SEMI JOIN d USING (g)
), s AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM m) GROUP BY r, k
), c AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY r
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.r IS NULL THEN x ELSE list_aggregate(list_transform(range(1, len(starts) + 2), lambda j: CASE WHEN j = 1 THEN substr(x, 1, 2 * starts[1]) WHEN j <= len(starts) THEN substr(x, 2 * ends[j - 1] + 1, 2 * (starts[j] - ends[j - 1])) ELSE substr(x, 2 * ends[j - 1] + 1) END), 'string_agg', '') END)) AS kept_sha256
FROM h LEFT JOIN c USING (r)
"""


#: crc32 of a short ASCII string `x`, by its table `t`.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"

OP11_SQL = f"""
WITH tab AS ({CRC_TABLE}), o AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC.format(x="CAST(conv_id AS VARCHAR)")} % 6 AS h,
    list({{'d': d, 'n': length(text)}} ORDER BY turn NULLS FIRST, role, d) AS own
  FROM o, tab GROUP BY conv_id, t
), p AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS path
  FROM c LEFT JOIN c b ON b.conv_id = c.base
), m AS (
  SELECT conv_id, d AS depth, len(path) AS size, CASE WHEN d > 0 THEN path[d].n ELSE 0 END AS n,
    array_to_string(list_transform(list_slice(path, 1, d), lambda x: x.d), ',') AS node,
    CASE WHEN d > 0 THEN array_to_string(list_transform(list_slice(path, 1, d - 1), lambda x: x.d), ',') END AS parent,
    list_transform(range(d + 1), lambda i: array_to_string(list_transform(list_slice(path, 1, i), lambda x: x.d), ',')) AS line
  FROM p, LATERAL (SELECT unnest(range(len(path) + 1)) AS d)
), g AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, any_value(line) AS line,
    sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM m GROUP BY node, depth
), k AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL
), f AS (
  SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (node, depth)
), s AS (
  SELECT a.x AS node, a.i - 1 AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
  FROM f, LATERAL (SELECT unnest(line) AS x, generate_subscripts(line, 1) AS i) a GROUP BY ALL
)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.node = f.node AND s.depth = f.depth LEFT JOIN f u ON u.node = f.parent AND u.depth = f.depth - 1
"""

#: The state of each conversation after each row: for every grammar state the least (cost, audit), with the repaired lines so far.
OP12_SQL = rf"""
WITH RECURSIVE tab AS ({CRC_TABLE}), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC.format(x="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS lot
  FROM conversations, tab
), d AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM o WHERE lot <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, sha256(length(role) || ':' || role || text) AS h FROM d
), r AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS c, row_number() OVER w AS i,
    lag(substr(role, 1, 1)) OVER w AS before,
    CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN right(regexp_replace(text, '[ 	-]+$', ''), 1) IN ('.', '!', '?') THEN 'good' ELSE 'truncated' END AS kind
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h, nth)
), a AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank,
    count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), t(q, c, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), x(q, j, z, put) AS (VALUES (0, 0, 0, []::VARCHAR[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']),
  (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 2, 3, ['user:', 'assistant:'])
), s AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM a
  UNION ALL
  SELECT conv_id, i, q, m.cost, m.audit, m.lines FROM (
    SELECT s.conv_id, r.i, e.q, min({{'cost': s.cost + 3 * x.j + e.cost, 'audit': s.audit || repeat('I', x.j) || e.letter, 'lines': list_concat(s.lines, x.put, e.line)}}) AS m
    FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN x ON x.q = s.q,
    LATERAL (
      SELECT x.z AS q, 4 AS cost, 'D' AS letter, []::VARCHAR[] AS line
      UNION ALL SELECT t.z, CASE WHEN r.kind = 'truncated' THEN 3 ELSE 0 END, 'K', [r.role || ':' || r.text] FROM t WHERE t.q = x.z AND t.c = r.c AND r.kind IN ('good', 'truncated')
      UNION ALL SELECT CASE WHEN x.z = 2 THEN 3 ELSE 2 END, CASE WHEN r.kind = 'truncated' THEN 6 ELSE 3 END, 'R', [CASE WHEN x.z = 2 THEN 'assistant:' ELSE 'user:' END || r.text] WHERE r.kind IN ('good', 'truncated')
    ) e GROUP BY s.conv_id, r.i, e.q
  )
), b AS (
  SELECT s.conv_id, min({{'cost': s.cost + 3 * x.j, 'audit': s.audit || repeat('I', x.j), 'lines': list_concat(s.lines, x.put)}}) AS m
  FROM s JOIN a ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.n = s.i JOIN x ON x.q = s.q WHERE x.z IN (0, 3) GROUP BY s.conv_id
)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(m.cost, 0) AS BIGINT) AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(array_to_string(m.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM o) z LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM z.conv_id
"""
