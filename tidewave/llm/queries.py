"""The queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, mixing, overlap, pii, resampling, runs, sharding, simhash, sstable, toxicity, warc, weak_supervision, wrappers
from .common import table

N_SHARDS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), N_SHARDS)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.store(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_supervision.judge(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("found")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def held_out(doc_id):
    """Rows whose labels are kept for the test."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Trained on the labelled documents that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.similar_documents(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), loops=True)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_sharding, op2_simhash, op3_sstable, op4_quality, op5_html, op6_decontamination, op7_warc, op8_pii, op9_mixing, op10_toxicity,
        op11_similarity, op12_runs, op13_resampling,
    )
    return {f.__name__: f for f in found}


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, with the usual table of 256 steps made by its rule."""
    steps = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        steps.append(i)
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, CAST({steps} AS BIGINT[])[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _place_sql(key: str, n: int) -> str:
    """The shard by three rounds of draws, as in sharding.place()."""
    tree = sharding._children(sharding.topology(n))
    nodes = "MAP {" + ", ".join(
        f"'{parent}': [" + ", ".join(f"{{'name': '{c}', 'weight': {w}}}" for c, w in below.items()) + "]" for parent, below in tree.items()
    ) + "}"
    at = "''"
    for _ in range(3):
        u = f"(CAST('0x' || substr(md5({key} || '|' || c.name), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496"
        at = f"list_min(list_transform(({nodes})[{at}], lambda c: {{'draw': -ln({u}) / c.weight, 'name': c.name}})).name"
    return f"CAST(substr({at}, 2) AS INTEGER)"


def _op1_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, md5(k) AS o, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size,
  CAST({_crc32_sql("t")} AS BIGINT) AS text_crc32, {_place_sql("k", N_SHARDS)} AS shard, {_place_sql("k", N_SHARDS + 1)} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


_OP7_SQL = f"""WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST_BYTES} AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_BYTES} AND page_id < best THEN best END AS refers_to FROM m"""

_OP9_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('0|' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)
  / greatest(0.05::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * (length(t) - length(translate(t, '#*$%&|<>0123456789', ''))) / greatest(length(t), 1)) AS key FROM d),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM r GROUP BY source),
w AS (SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM n),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, source) AS i FROM w WHERE n > 0),
c AS (SELECT *, CAST((SELECT sum(n) FROM w) - coalesce(sum(3 * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share FROM o),
k AS (SELECT min(i) AS i FROM c WHERE share * w <= 3 * n),
g AS (SELECT source, n, CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN c.i < k.i OR k.i IS NULL THEN CAST(3 * n AS DOUBLE)
  ELSE (SELECT share FROM c c2 WHERE c2.i = k.i) * w END AS target FROM c CROSS JOIN k),
e AS (SELECT *, CAST(least(3, floor(target / n)) AS BIGINT) AS epochs FROM g WHERE n > 0),
u AS (SELECT r.*, e.n, e.target, e.epochs, e.target - e.epochs * e.n AS budget,
  coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target, CAST(size * (epochs + (budget > 0 AND used + size / 2.0::DOUBLE <= budget)::INT) AS BIGINT) AS taken FROM u"""


_OP11_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM d, range(1, greatest(len(w) - 3, least(len(w), 1)) + 1) AS a(i)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS (SELECT x.r AS a, y.r AS b FROM s x JOIN s y ON x.g = y.g AND x.r < y.r JOIN n ON n.r = x.r JOIN n m ON m.r = y.r
  GROUP BY x.r, y.r HAVING 100 * count(*) >= 85 * (any_value(n.n) + any_value(m.n) - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(a, b) AS (SELECT r, r FROM d UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a),
k AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN k USING (r)"""


def _op13_sql() -> str:
    """The checksum of each different n-gram is taken once."""
    grams = "SELECT {key}, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM {words}, range(1, 4) AS a(n), range(1, len(w) + 2 - n) AS b(i)"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
s AS ({grams.format(key="r", words="d")}),
t AS ({grams.format(key="0 AS r", words="b")}),
k AS (SELECT g, {_crc32_sql("g")} % {resampling.BUCKETS} AS bucket FROM (SELECT g FROM s UNION SELECT g FROM t)),
sb AS (SELECT bucket, count(*) AS c FROM s JOIN k USING (g) GROUP BY bucket),
tb AS (SELECT bucket, count(*) AS c FROM t JOIN k USING (g) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(tb.c, 0) + 1) * CAST((SELECT count(*) FROM s) + 10000 AS DOUBLE)
  / ((coalesce(sb.c, 0) + 1) * CAST((SELECT count(*) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sb FULL JOIN tb USING (bucket)),
w AS (SELECT r, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM s JOIN k USING (g) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT doc_id, len(w) >= {resampling.LEAST_WORDS} AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
  / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS pos, count(*) FILTER (WHERE fit) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND pos <= n * {resampling.PERCENT} // 100 THEN pos END AS rank FROM o"""


def oracle_sql() -> dict[str, str]:
    """The other operators depend on XXH64, tokenizers, models or edit distances, and have tests instead."""
    return {"op1_sharding": _op1_sql(), "op7_warc": _OP7_SQL, "op9_mixing": _OP9_SQL, "op11_similarity": _OP11_SQL, "op13_resampling": _op13_sql()}
