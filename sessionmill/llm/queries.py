"""Registered queries of the training-data operators, each over its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (fingerprints, importance, language_id, packing, page_text, periodic, secrets, sharding, simhash, token_counts, token_files,
               vector_dedup, viterbi)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL that must give the same rows where SQL can express it."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_secret_scans(spark, sf_dir):
    found = secrets.find_secrets(documents(spark, sf_dir), ["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("secrets")).alias("spans"))


# A paragraph's digest is 60 bits of its MD5; a sketch has 3 x 12 cells, and a digest's bits 0-19, 20-39, 40-59 choose one in each 12.
@query("""
WITH o AS (SELECT doc_id, coalesce(text, '') t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) nx,
                  first_value(coalesce(text, '')) OVER (ORDER BY doc_id) f FROM documents),
 e AS (SELECT doc_id, t, coalesce(nx, f) nx, length(t) n, left(t, length(t) - length(t) // 2) || left(coalesce(nx, f), length(t) // 2) ed FROM o),
 lines AS (SELECT DISTINCT doc_id, side, ('0x' || left(md5(p), 15))::BIGINT k FROM (
     SELECT doc_id, 'own' side, unnest(string_split(t, chr(10))) p FROM e UNION ALL
     SELECT doc_id, 'edited', unnest(string_split(ed, chr(10))) FROM e UNION ALL
     SELECT doc_id, 'next', unnest(string_split(nx, chr(10))) FROM e) WHERE p <> ''),
 full_cells AS (SELECT doc_id, side, i, count(k) n, coalesce(bit_xor(k), 0) x, coalesce(bit_xor(k % 2147483647 * 1000003 % 4294967291), 0) c
     FROM (SELECT doc_id FROM e) CROSS JOIN (VALUES ('own'), ('edited')) s(side) CROSS JOIN range(0, 36) r(i)
     LEFT JOIN lines USING (doc_id, side) WHERE k IS NULL OR ((k >> (20 * (i // 12))::INT) & 1048575) % 12 = i % 12 GROUP BY ALL),
 every AS (SELECT doc_id, side, i, coalesce(n, 0) n, coalesce(x, 0) x, coalesce(c, 0) c
     FROM (SELECT doc_id FROM e) CROSS JOIN (VALUES ('own'), ('edited')) s(side) CROSS JOIN range(0, 36) r(i) LEFT JOIN full_cells USING (doc_id, side, i)),
 prints AS (SELECT doc_id, side, string_agg(lower(to_hex(n)) || '.' || lower(to_hex(x)) || '.' || lower(to_hex(c)), ',' ORDER BY i) p FROM every GROUP BY ALL),
 sets AS (SELECT doc_id, list(k) FILTER (side = 'own') a, list(k) FILTER (side = 'edited') b, list(k) FILTER (side = 'next') c FROM lines GROUP BY ALL),
 sizes AS (SELECT e.doc_id, coalesce(a, []) a, coalesce(b, []) b, coalesce(c, []) c FROM e LEFT JOIN sets USING (doc_id))
SELECT e.doc_id, n AS n_chars, sha256(ed) AS edited_sha256, p1.p AS fingerprint, p2.p AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE (2 * len(list_intersect(a, b)))::DOUBLE / (2 * (len(a) + len(b) - len(list_intersect(a, b))))::DOUBLE END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE (2 * len(list_intersect(a, c)))::DOUBLE / (2 * (len(a) + len(c) - len(list_intersect(a, c))))::DOUBLE END AS near_next
FROM e JOIN sizes USING (doc_id) JOIN prints p1 ON p1.doc_id = e.doc_id AND p1.side = 'own' JOIN prints p2 ON p2.doc_id = e.doc_id AND p2.side = 'edited'
""")
def op2_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


@query()
def op3_sentencepiece(spark, sf_dir):
    return viterbi.round_trip(documents(spark, sf_dir))


@query()
def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir))


@query()
def op5_packing(spark, sf_dir):
    packed = packing.pack_documents(documents(spark, sf_dir), ["doc_id"])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op6_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


@query("""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS h FROM documents),
 l AS (SELECT doc_id, bytes, h, depth::INT AS depth, h >> (60 - depth)::INT AS up FROM d CROSS JOIN range(0, 61) t(depth)),
 s AS (SELECT depth, up FROM l GROUP BY ALL HAVING sum(bytes) <= 2097152),
 m AS (SELECT doc_id, bytes, h, min(depth) AS depth FROM l JOIN s USING (depth, up) GROUP BY ALL)
SELECT doc_id, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS prefix, 0::BIGINT AS page FROM m
""")
def op7_sharding(spark, sf_dir):
    return sharding.assign(documents(spark, sf_dir))


@query()
def op8_simhash_near_dedup(spark, sf_dir):
    out = simhash.with_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op9_token_id_files(spark, sf_dir):
    return token_files.round_trip(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
     AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
 n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
""")
def op10_embedding_near_dedup(spark, sf_dir):
    return vector_dedup.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def repeating(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the documents, by the CRC-32 of the id, the words from some place on are the first few words
    there, over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", text.alias("text"), h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("bigint")
    some = some.withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("bigint"))
    again = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.get(
        F.col("words"), F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return some.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op11_periodic_runs(spark, sf_dir):
    found = periodic.find_runs(repeating(documents(spark, sf_dir)), ["doc_id"])
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  length / period, compared without division
    best = F.get(F.array_sort("runs", lambda x, y: F.when(more(x, y) != 0, -F.signum(more(x, y))).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
                              .otherwise(F.signum(x["period"] - y["period"])).cast("int")), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query()
def op12_html_extraction(spark, sf_dir):
    return page_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])


# CRC-32 byte by byte, with its table made by eight halvings of each byte; every distinct word is hashed once.
@query("""
WITH tab AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) c
     FROM range(256) r(i))),
 w AS (SELECT 'd' side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w FROM documents
   UNION ALL SELECT 't', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
 bytes AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT) b FROM (SELECT DISTINCT w FROM w)),
 hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 10000 k FROM bytes, tab),
 f AS (SELECT side, doc_id, k FROM w JOIN hashed USING (w)),
 n AS (SELECT count(*) FILTER (side = 'd') s, count(*) FILTER (side = 't') t FROM f),
 gain AS (SELECT k, floor(1000 * ln(((count(*) FILTER (side = 't') + 1)::DOUBLE * (n.s + 10000)::DOUBLE)
     / ((count(*) FILTER (side = 'd') + 1)::DOUBLE * (n.t + 10000)::DOUBLE)))::BIGINT g FROM f, n GROUP BY k, n.s, n.t),
 weights AS (SELECT doc_id, count(*) n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT weight FROM f JOIN gain USING (k) WHERE side = 'd' GROUP BY doc_id),
 scored AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT n_features, coalesce(weight, 0)::BIGINT weight,
     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT score
     FROM documents d LEFT JOIN weights USING (doc_id)),
 placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r, count(*) OVER () n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
""")
def op13_importance_resampling(spark, sf_dir):
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
