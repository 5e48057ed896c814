"""One query for each operator, over its whole table, with the columns that its contract names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, common, exact, lm, near, packing, phrases, pii, quality, shards, token_files, toxicity, vectors


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5)
    out = quality.score(docs, model)
    return out.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op4_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), g AS (
    SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


OP3_SQL = """
WITH RECURSIVE fine AS (
    SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.id AS a, b.id AS b FROM fine a JOIN fine b ON a.id <> b.id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95
), reach AS (
    SELECT a AS id, a AS root FROM link UNION SELECT link.b, root FROM reach JOIN link ON link.a = reach.id AND root < link.b
), c AS (SELECT id, min(root) AS root FROM reach GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(root, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id
"""


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.frugal(spark)
    return near.jaccard_components(documents(spark, sf_dir), width=4, num=85, den=100)


OP5_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a AS id, a AS root FROM link UNION SELECT link.b, root FROM reach JOIN link ON link.a = reach.id AND root < link.b),
c AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = doc_id
"""


def op6_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows arrive in eight parts, each a version; tiers are merged, and the rows are read back by the last manifest."""
    docs = documents(spark, sf_dir)
    table = shards.shard(docs, common.new_path(spark, "shards"), arrivals=8, target_bytes=128 << 20)
    rows = sum(s.rows for s in table.manifest())
    return table.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.lit(rows).cast("long").alias("manifest_rows"))


OP6_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, count(*) OVER () AS manifest_rows FROM documents"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_texts(documents(spark, sf_dir), ranks, decoded_col="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), folds=10)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, final = centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, width=64, scale=1024, seed=3)
    hashes = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(final.tolist())]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    sums = own.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(named), "cluster")  # a row for each centroid
    sums = sums.crossJoin(F.broadcast(own.agg(F.sum("distance").alias("inertia"))))
    out = own.join(F.broadcast(sums), "cluster")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sql(rounds: int = 10) -> str:
    """Each round is a query of its own: assignment, then the floor of each component's mean."""
    nearest = """a{i} AS MATERIALIZED (
    SELECT rid, q, k, d FROM (SELECT rid, v.q AS q, k, list_sum(list_transform(range(1, 65), lambda j: (v.q[j] - c.q[j]) * (v.q[j] - c.q[j])))::BIGINT AS d FROM v, c{i} c)
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1
)"""
    means = """s{i} AS (SELECT k, j, sum(q[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY k, j),
c{next} AS MATERIALIZED (
    SELECT k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM s{i} GROUP BY k) m USING (k)
)"""
    start = """WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < 8)"""
    steps = [x.format(i=i, next=i + 1) for i in range(rounds) for x in (nearest, means)]
    end = f"""SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c USING (k)"""
    return ",\n".join([start, *steps, nearest.format(i=rounds)]) + "\n" + end


OP12_SQL = op12_sql()


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), most_words=3, least=10, most=2000, covered=50)


OP13_SQL = r"""
WITH piece AS (
    SELECT doc_id, lang, generate_subscripts(p, 1) AS no, unnest(p) AS piece FROM (
        SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
run AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k
), f AS (SELECT lang, k, phrase, count(*) AS f FROM run GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
inner_ AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3),
best AS (SELECT lang, phrase, max(a) AS best FROM inner_ GROUP BY ALL),
free AS (SELECT c.* FROM c LEFT JOIN best USING (lang, phrase) WHERE best IS NULL OR 100 * best < 50 * a),
cut AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1 : k], ' ') AS y FROM free, (VALUES (1), (2)) AS t(cut) WHERE cut < k),
scored AS (
    SELECT cut.lang, cut.phrase, cut, a, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN n USING (lang) QUALIFY rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_attention_quality": op1_attention_quality,
    "op2_crf_pii": op2_crf_pii,
    "op3_multi_index": op3_multi_index,
    "op4_bloom_dedup": op4_bloom_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_tiered_shards": op6_tiered_shards,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_katz_scores": op9_katz_scores,
    "op10_token_files": op10_token_files,
    "op11_noisy_channel_toxicity": op11_noisy_channel_toxicity,
    "op12_hamerly_clusters": op12_hamerly_clusters,
    "op13_phrase_automata": op13_phrase_automata,
}

ORACLES: dict[str, str] = {
    "op3_multi_index": OP3_SQL,
    "op4_bloom_dedup": OP4_SQL,
    "op5_ngram_join": OP5_SQL,
    "op6_tiered_shards": OP6_SQL,
    "op12_hamerly_clusters": OP12_SQL,
    "op13_phrase_automata": OP13_SQL,
}
