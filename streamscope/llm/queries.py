"""The dealt operators as named queries over the tables of a folder, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import packed_digest

    return packed_digest(table(spark, folder, "documents"))


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .rules import verdicts

    return verdicts(table(spark, folder, "documents"))


@query
def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, folder, "documents"))


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .linededup import line_report

    return line_report(table(spark, folder, "documents"))


@query
def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    from .chat import conversation_digest

    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversation_digest(rows.unionByName(extra))


@query
def op10_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    from .codes import token_files

    return token_files(table(spark, folder, "documents"))


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from .langid import identified

    return identified(table(spark, folder, "documents"))


@query
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


SQL["op2_top_k"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.own AS own, c.vec_id AS vec_id,
    CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20"""


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Windows of at least fifty words, from each line on and up to each line; those whose lines stand
# earlier as well are deleted.
SQL["op5_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(COALESCE(text, ''), chr(10)) AS parts FROM documents),
n AS (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM d),
w AS (SELECT doc_id, i, len(regexp_extract_all(parts[i + 1], '[^\x20\x09-\x0D]+')) AS words FROM n),
c AS (SELECT doc_id, i, SUM(words) OVER o AS upto, SUM(words) OVER o - words AS before
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT doc_id, upto, MIN(i) AS i FROM c GROUP BY ALL),
b AS (SELECT doc_id, before, MAX(i) AS i FROM c GROUP BY ALL),
s AS (
  SELECT c.doc_id, c.i AS first, e.i AS last FROM c ASOF JOIN e ON c.doc_id = e.doc_id AND c.before + 50 <= e.upto
  UNION SELECT c.doc_id, b.i, c.i FROM c ASOF JOIN b ON c.doc_id = b.doc_id AND c.upto - 50 >= b.before
),
t AS (SELECT s.doc_id, first, last, array_to_string(parts[first + 1 : last + 1], chr(10)) AS run FROM s JOIN d ON s.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM t),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM r WHERE nth > 1),
k AS (SELECT n.doc_id, COUNT(*) AS n_lines, COUNT(g.i) AS deleted_lines,
    COALESCE(string_agg(n.parts[n.i + 1], chr(10) ORDER BY n.i) FILTER (g.i IS NULL), '') AS text
  FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id)
SELECT k.doc_id, n_lines, deleted_lines, CASE WHEN d.text IS NOT NULL THEN k.text END AS text FROM k JOIN d ON k.doc_id = d.doc_id"""


@query
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from .licenses import license_report

    return license_report(table(spark, folder, "documents"))


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    from .infill import infill_digest

    return infill_digest(table(spark, folder, "documents"))


SQL["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h,
    regexp_extract_all(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
), x AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
      THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x
), c AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
    array_to_string(units[b + 1:], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256 FROM c"""


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from .manifest import manifest_report

    return manifest_report(table(spark, folder, "documents"))


# Trees by recursion over levels; a proof is the nodes beside a leaf's run at each level; a
# tampered leaf climbs by recursion over its siblings.
SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS c, source, text,
    CASE WHEN regexp_matches(text, '[A-Z]') THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low
  FROM documents
), v AS (
  SELECT *, COALESCE(strlen(i) || ':' || i, '-') || COALESCE(strlen(source) || ':' || source, '-')
    || COALESCE(strlen(lang) || ':' || lang, '-') || COALESCE(strlen(c) || ':' || c, '-') AS head FROM d
), bits AS (
  SELECT doc_id, i, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(ch)::UBIGINT FOR ch IN string_split(i, '')]),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)::UBIGINT[]),
      lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::UBIGINT) ELSE y // 2 END)) AS r FROM (SELECT DISTINCT doc_id, i FROM d)
), l AS (
  SELECT v.doc_id, v.lang, sha256(head || COALESCE(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(r, 4294967295::UBIGINT) % 3 = 0 THEN sha256(head || COALESCE(strlen(low) || ':' || low, '-')) END AS bad
  FROM v LEFT JOIN bits ON v.doc_id = bits.doc_id
), k AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), up AS (
  SELECT g, 0 AS h, pos, leaf AS digest FROM k
  UNION ALL
  SELECT g, h + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY g) AS c FROM up) WHERE c > 1 GROUP BY g, h, pos // 8
), sub AS (SELECT g, MAX(h) AS h, arg_max(digest, h) AS subroot FROM up WHERE pos = 0 GROUP BY g),
top AS (
  SELECT 0 AS h, g AS pos, subroot AS digest FROM sub
  UNION ALL
  SELECT h + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, COUNT(*) OVER () AS c FROM top) WHERE c > 1 GROUP BY h, pos // 8
), rt AS (SELECT arg_max(digest, h) AS root FROM top WHERE pos = 0),
own AS (SELECT row_number() OVER () AS id, k.*, sub.subroot, sub.h AS height FROM k JOIN sub USING (g)),
beside AS (
  SELECT o.id, u.h AS step, u.pos, u.digest, u.pos < o.pos // (8 ** u.h)::BIGINT AS before
  FROM own o JOIN up u ON u.g = o.g AND u.pos // 8 = o.pos // (8 ** (u.h + 1))::BIGINT AND u.pos <> o.pos // (8 ** u.h)::BIGINT
  UNION ALL
  SELECT o.id, o.height + u.h, u.pos, u.digest, u.pos < o.g // (8 ** u.h)::BIGINT
  FROM own o JOIN top u ON u.pos // 8 = o.g // (8 ** (u.h + 1))::BIGINT AND u.pos <> o.g // (8 ** u.h)::BIGINT
), proof AS (SELECT id, sha256(string_agg(digest, '' ORDER BY step, pos)) AS proof FROM beside GROUP BY id),
steps AS (
  SELECT o.id, s.step, COALESCE(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.before), '') AS lhs,
    COALESCE(string_agg(b.digest, '' ORDER BY b.pos) FILTER (NOT b.before), '') AS rhs
  FROM own o JOIN (SELECT DISTINCT h AS step FROM (SELECT unnest(range((SELECT MAX(height) FROM own) + (SELECT MAX(h) FROM top))) AS h)) s
    ON s.step < o.height + (SELECT MAX(h) FROM top)
  LEFT JOIN beside b ON b.id = o.id AND b.step = s.step GROUP BY o.id, s.step
), climb AS (
  SELECT id, 0 AS step, COALESCE(bad, leaf) AS digest FROM own
  UNION ALL
  SELECT c.id, c.step + 1, sha256(s.lhs || c.digest || s.rhs) FROM climb c JOIN steps s ON s.id = c.id AND s.step = c.step
), ended AS (SELECT id, arg_max(digest, step) AS folded_root FROM climb GROUP BY id)
SELECT doc_id, leaf, subroot, root, COALESCE(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM own JOIN ended USING (id) LEFT JOIN proof USING (id) CROSS JOIN rt"""
