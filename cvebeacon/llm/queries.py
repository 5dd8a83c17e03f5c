"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvebeacon.llm import (
    conversation_trie,
    learned_search,
    lines,
    minhash,
    mixing,
    neardup_vectors,
    packing,
    quality,
    rules,
    secrets,
    sharding,
    toxicity,
    whitening,
)
from cvebeacon.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id,
    regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i
        FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r(node, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id,
  c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""


#: Folder of the public tokenizers where their package is not installed.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file here; a task that lacks it looks in its own package."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(TOKENIZERS, name)
    return str(public_tokenizers.path(name))


_LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
e AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
r(node, reached) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.component_id = d.vec_id AS kept
FROM embeddings d JOIN c ON c.node = d.vec_id LEFT JOIN n ON n.a = d.vec_id
"""


@query("op1_embedding_near_dedup", _LINKS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of equal label with a cosine of 0.98 or more."""
    return neardup_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; held-out rows were never learned from."""
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


_LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line,
    list_distinct(regexp_extract_all({_ASCII_LOWER.format("ls[i]")}, '[^\\x20\\x09-\\x0D]+')) AS ws
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
t AS (SELECT doc_id, line, list_sort(ws) AS ws FROM l WHERE len(ws) >= 1),
k AS (SELECT ws, min((doc_id, line)) AS pos, len(ws) AS n FROM t GROUP BY ws),
w AS (SELECT pos, n, ws, unnest(ws) AS w FROM k),
f AS (SELECT w, count(*) AS df FROM w GROUP BY w),
p AS (
  SELECT * FROM (
    SELECT pos, n, ws, w.w, row_number() OVER (PARTITION BY pos ORDER BY df, w.w) AS place
    FROM w JOIN f ON f.w = w.w)
  WHERE place <= n - (n * 80 + 99) // 100 + 1),
g AS (
  SELECT DISTINCT b.pos FROM p a JOIN p b ON a.w = b.w AND a.pos < b.pos
  WHERE 100 * len(list_intersect(a.ws, b.ws)) >= 80 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
x AS (
  SELECT t.doc_id, t.line FROM t JOIN k USING (ws)
  WHERE k.pos <> (t.doc_id, t.line) OR k.pos IN (SELECT pos FROM g)),
r AS (
  SELECT doc_id, count(*) AS n, string_agg(line, ',' ORDER BY line) AS lines FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.lines, '') AS removed_lines,
  CASE WHEN r.n IS NULL THEN d.text ELSE (
    SELECT coalesce(string_agg(s.line_text, chr(10) ORDER BY s.i), '')
    FROM (SELECT unnest(string_split(d.text, chr(10))) AS line_text,
            generate_subscripts(string_split(d.text, chr(10)), 1) AS i) s
    WHERE NOT list_contains(string_split(r.lines, ','), CAST(s.i - 1 AS VARCHAR))) END AS text
FROM documents d LEFT JOIN r USING (doc_id)
"""


@query("op3_line_dedup", _LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line resembles by 0.8 or more."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
        "text",
    )


@query("op4_mixture_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, sources in proportion."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.Packing(tokenizer_path()))


@query("op5_sampled_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by fixed patterns and by novelty."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op7_learned_search")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return learned_search.search(table(spark, sf_dir, "embeddings"))


@query("op9_temperature_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn pass by pass so that sources reach their tempered weights."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op8_minhash_near_dedup", _NEAR_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with at least 0.8 of their four-word shingles in common."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHash(words=4))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; held-out rows were never learned from."""
    return quality.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their eight largest components, scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_quality_rules")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the base rules and the learned decision list."""
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_TRIE_SQL = """
WITH t AS (
  SELECT conv_id AS c, md5(length(r)::VARCHAR || ':' || r || x) AS id,
    len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(r)::VARCHAR || ':' || r || x)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
        FROM conversations WHERE conv_id IS NOT NULL)),
h AS (
  SELECT c, xor(list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
        lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
        ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END),
    4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT h.c, 0 AS k, pos, id, words FROM h JOIN t ON t.c = h.c - h.c % 20 AND pos <= h
  UNION ALL SELECT h.c, 1, pos, id, words FROM h JOIN t ON t.c = h.c AND pos > h),
p AS (
  SELECT h.c, coalesce(list(id ORDER BY k, pos) FILTER (WHERE id IS NOT NULL), []) AS ids,
    coalesce(list(words ORDER BY k, pos) FILTER (WHERE id IS NOT NULL), []) AS ws
  FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
n AS (
  SELECT key, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = size), '')) AS ends
  FROM (SELECT c, d, ids[1:d] AS key, coalesce(ws[d], 0) AS w, len(ids) AS size
        FROM (SELECT *, unnest(generate_series(0, len(ids))) AS d FROM p))
  GROUP BY key, d),
k AS (
  SELECT n.*, q.conv_id AS parent, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.key[1:n.d] = n.key) AS children
  FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.key = n.key[1:n.d - 1]),
s AS (
  SELECT key[1:a] AS key, a AS d, sum((children = 0)::INT) AS leaves, sum((n - 1) * w) AS saved
  FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM k) GROUP BY 1, 2)
SELECT k.conv_id, k.d AS depth, k.parent AS parent_conv_id, k.n AS n_convs, k.children AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.key = k.key
"""


@query("op11_conversation_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))
