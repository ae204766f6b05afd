"""Queries over the driver's tables, one for each operator, and the SQL that checks those SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find_pii, label

    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda nth: F.size(F.filter("spans", lambda x: x["kind"] == nth)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *(count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)), F.sha2(label(base), 256).alias("base_sha256"), label(F.col("spans")).alias("spans"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# windows are taken from pieces of 512 starts, in hexadecimal
ORACLES["op2_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, n * 512 AS low, substr(h, n * 1024 + 1, 1422) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 200, -1) // 512 + 1)) AS n FROM d WHERE length(h) >= 400)),
w AS (SELECT doc_id, low + i AS i, md5(substr(s, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, low, s, unnest(range(0, least(512, length(s) // 2 - 199))) AS i FROM pieces)),
k AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
c AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN k USING (k)),
g AS (SELECT doc_id, i, sum((gap IS NULL OR gap > 200)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, nth),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM o JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .image_copies import image_copies, rendered

    return image_copies(rendered(_table(spark, sf_dir, "embeddings")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import backoff_scores

    return backoff_scores(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("logprob", 3).alias("logprob"))


ORACLES["op4_lm_scoring"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t0 AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS p FROM d),
t AS (SELECT r, p, w, lag(w) OVER x AS v, lag(w, 2) OVER x AS u FROM t0 WINDOW x AS (PARTITION BY r ORDER BY p)),
c1 AS (SELECT w, count(*) AS n1 FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n2 FROM t WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n3 FROM t WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT t.r, p, ln(c1.n1 / (SELECT count(*) FROM t)::DOUBLE) AS s1,
    CASE WHEN p >= 1 AND c2.n2 >= 2 THEN ln(c2.n2 / b1.n1::DOUBLE) END AS s2,
    CASE WHEN p >= 2 AND c3.n3 >= 2 THEN ln(c3.n3 / b2.n2::DOUBLE) END AS s3
  FROM t JOIN c1 USING (w) LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN c1 b1 ON b1.w = t.v
  LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w LEFT JOIN c2 b2 ON b2.v = t.u AND b2.w = t.v),
y AS (SELECT r, sum(coalesce(s3, CASE WHEN p >= 2 THEN ln(0.4) ELSE 0 END + coalesce(s2, CASE WHEN p >= 1 THEN ln(0.4) ELSE 0 END + s1))) AS total FROM s GROUP BY r)
SELECT doc_id, len(w) AS n_words, round(coalesce(total, 0), 3) AS logprob FROM d LEFT JOIN y USING (r)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    out = rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return out.select("conv_id", "speaker", "chunk", "piece", "n_turns", "rendered", spans.alias("mask_spans"))


ORACLES["op6_chat_rotation"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, CASE WHEN conv_id IS NOT NULL THEN floor(turn / 64.0)::BIGINT END AS chunk
  FROM conversations
), n AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY conv_id, turn, role, text) AS copy,
    greatest(ceil(count(*) OVER w / 256), ceil(sum(length(text)) OVER w / 4194304))::BIGINT AS pieces
  FROM t WINDOW w AS (PARTITION BY conv_id, chunk)
), g AS (
  SELECT *, CASE WHEN chunk IS NULL THEN r ELSE -1 END AS own,
    CASE WHEN chunk IS NULL OR pieces = 1 THEN 0 ELSE ('0x' || substr(md5(concat_ws(chr(10), turn, role, text, copy)), 1, 8))::BIGINT % pieces END AS piece
  FROM n
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE conv_id IS NOT NULL),
p0 AS (SELECT g.*, speaker FROM g JOIN s USING (conv_id) UNION ALL SELECT g.*, role FROM g WHERE conv_id IS NULL),
p AS (
  SELECT *,
    CASE WHEN role = speaker THEN '<|assistant|>' ELSE '<|user:' || replace(role, '|>', '| >') || '|>' END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM p0
), o AS (
  SELECT *, row_number() OVER w AS nth,
    sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, chunk, piece, own ORDER BY turn, role, text, copy ROWS UNBOUNDED PRECEDING) AS upto
  FROM p WINDOW w AS (PARTITION BY conv_id, speaker, chunk, piece, own ORDER BY turn, role, text, copy)
)
SELECT conv_id, speaker, chunk, piece, count(*) AS n_turns, string_agg(head || body, '' ORDER BY nth) AS rendered,
  coalesce(string_agg((upto - length(body))::BIGINT || ':' || upto::BIGINT, ',' ORDER BY nth) FILTER (WHERE role = speaker), '') AS mask_spans
FROM o GROUP BY conv_id, speaker, chunk, piece, own
"""


#: A public SentencePiece model; the path is a parameter of the operator.
MODEL_FILE = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encode

    coded = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL_FILE, decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


#: Components of links (a, b) by reachability from each id.
_REACHED = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reached(id, seen) AS (SELECT {id}, {id} FROM {table} UNION SELECT reached.id, e.b FROM reached JOIN e ON e.a = reached.seen),
c AS (SELECT id, min(seen) AS component_id FROM reached GROUP BY id)"""
ORACLES["op9_minhash_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
{_REACHED.format(id="doc_id", table="d")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON id = doc_id
"""


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


ORACLES["op10_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id < q.vec_id WHERE CASE WHEN len(p.x) = len(q.x) THEN list_cosine_similarity(p.x, q.x) >= 0.93 END),
{_REACHED.format(id="vec_id", table="v")},
f AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON id = vec_id LEFT JOIN f ON a = vec_id
"""


QUERIES |= {f.__name__: f for f in (op1_pii, op2_suffix_dedup, op3_image_copies, op4_lm_scoring, op5_mixing, op6_chat_rotation, op7_sentencepiece, op8_language_id, op9_minhash_dedup, op10_embedding_dedup)}
