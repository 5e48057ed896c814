"""Queries of the data pipeline, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.ids import padded_size
from tessera.functions.tokenizers import CHAR
from tessera.operators import chat, encode, metrics, mixing, records

from tessera import convert, options
from tessera.sources import mixture, readers, sink, writers
from tessera.sources.scratch import scratch
from tessera.streaming import sessions

from . import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chat_records(table(spark, sf_dir, "conversations"))


def good_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).where("error_code IS NULL")


def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = good_chats(spark, sf_dir).withColumn("segments", chat.segments(F.col("messages"))).where("segments IS NOT NULL")
    return own.withColumn("n", chat.token_counts(F.col("segments"))).select("conv_id", "segments", F.col("n.tokens").cast("long").alias("tokens"), F.col("n.supervised").cast("long").alias("supervised"))


def big(c: Column) -> Column:
    return c.cast("long")


#: Lengths and the profile of chats that the queries take; their SQL has the values.
LENGTHS, CHAT = options.Lengths(), options.PROFILES["chat_sft"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"""
WITH r AS (SELECT doc_id, {sql.strip('text')} AS text, nullif({sql.strip('source')}, '') AS source FROM documents)
SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source, length(text) AS chars, md5(text) AS text_md5,
    CASE WHEN text IS NULL THEN 'text_missing' WHEN text = '' THEN 'text_blank' WHEN doc_id IS NULL THEN 'id_missing' END AS error_code
FROM r
""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.normalize_text(documents(spark, sf_dir), record_id=F.col("doc_id"))
    return out.select("doc_id", "id", "source", big(F.char_length("text")).alias("chars"), F.md5("text").alias("text_md5"), "error_code")


@query(f"""
WITH m AS (SELECT conv_id, turn, role, {sql.strip('text')} AS content FROM conversations)
SELECT conv_id, count(*) AS messages, md5(string_agg(role || ':' || content, '|' ORDER BY turn)) AS messages_md5,
    CASE WHEN NOT bool_and(coalesce(role IN ('system', 'user', 'assistant', 'observation'), false)) THEN 'role_unknown'
         WHEN NOT bool_and(coalesce(content <> '', false)) THEN 'content_blank' END AS error_code,
    NOT bool_or(role = 'assistant') AS no_assistant
FROM m GROUP BY conv_id
""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return chats(spark, sf_dir).select("conv_id", big(F.size("messages")).alias("messages"), F.md5(joined).alias("messages_md5"), "error_code", (~F.exists("messages", lambda m: m["role"] == "assistant")).alias("no_assistant"))


@query("""
WITH r AS (
    SELECT 'text' AS type, coalesce(source, '<unknown>') AS source FROM documents
    UNION ALL SELECT 'chat', '<unknown>' FROM (SELECT DISTINCT conv_id FROM conversations)
)
SELECT 'type' AS kind, type AS name, count(*) AS records FROM r GROUP BY type
UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY source
""")
def type_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir).select(F.lit("text").alias("type"), "source")
    chats_ = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.lit("chat").alias("type"), F.lit(None).cast("string").alias("source"))
    return records.summary(texts.unionByName(chats_))


@query(f"""
WITH {sql.MESSAGES}
SELECT conv_id, length({sql.PROMPT} || E'\\n\\nAssistant: ') AS chars, md5({sql.PROMPT} || E'\\n\\nAssistant: ') AS prompt_md5 FROM g GROUP BY conv_id
""")
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = good_chats(spark, sf_dir).withColumn("prompt", chat.prompt(F.col("messages"), ask=True))
    return own.select("conv_id", big(F.char_length("prompt")).alias("chars"), F.md5("prompt").alias("prompt_md5"))


@query(f"""
WITH {sql.MESSAGES},
s AS (
    SELECT conv_id, turn, 0 AS part, {sql.LABEL} AS text, 'f' AS mark FROM g
    UNION ALL SELECT conv_id, turn, 1, content, CASE WHEN role = 'assistant' THEN 't' ELSE 'f' END FROM g
    UNION ALL SELECT conv_id, turn, 2, '{sql.EOS}', 't' FROM g WHERE role = 'assistant'
)
SELECT conv_id, 1 + count(*) AS segments, 'f' || string_agg(mark, '' ORDER BY turn, part) AS marks, md5('{sql.BOS}' || string_agg(text, '' ORDER BY turn, part)) AS text_md5
FROM s GROUP BY conv_id HAVING conv_id IN (SELECT conv_id FROM g WHERE role = 'assistant')
""")
def render_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_join(F.transform("segments", lambda s: F.when(s["supervise"], "t").otherwise("f")), "")
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return chat_tokens(spark, sf_dir).select("conv_id", big(F.size("segments")).alias("segments"), marks.alias("marks"), F.md5(text).alias("text_md5"))


@query(f"WITH {sql.CHAT_TOKENS} SELECT conv_id, CAST(tokens AS BIGINT) AS tokens, CAST(supervised AS BIGINT) AS supervised FROM t")
def supervised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tokens(spark, sf_dir).select("conv_id", "tokens", "supervised")


@query(f"""
WITH {sql.MESSAGES},
p AS (SELECT conv_id, {sql.PROMPT} AS text FROM g GROUP BY conv_id HAVING bool_or(role = 'assistant')),
c AS (SELECT conv_id, list_transform(regexp_extract_all(text, '(?s:{sql.SPECIAL}|.)'), lambda x: CASE x WHEN '{sql.BOS}' THEN 1114112 WHEN '{sql.EOS}' THEN 1114113 ELSE unicode(x) END) AS ids FROM p)
SELECT conv_id, len(ids) AS tokens, md5(array_to_string(ids[1:7680], ',')) AS ids_md5 FROM c
""")
def encode_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat_tokens(spark, sf_dir).select("conv_id", "tokens", chat.encoded(F.col("segments"), LENGTHS.train)["input_ids"].cast("array<string>").alias("ids"))
    return own.select("conv_id", "tokens", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query(f"""
WITH {sql.CHAT_TOKENS}, all_tokens AS (
    SELECT 'chat' AS kind, conv_id AS id, tokens, supervised FROM t
    UNION ALL SELECT 'text', doc_id, {sql.chars(sql.strip('text'))} + 1, {sql.chars(sql.strip('text'))} FROM documents WHERE {sql.strip('text')} <> ''
)
SELECT kind, count(*) AS samples, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(supervised) AS BIGINT) AS supervised,
    CAST(sum(least(tokens, 7680)) AS BIGINT) AS kept_tokens, count(*) FILTER (tokens > 7680) AS truncated
FROM all_tokens GROUP BY kind
""")
def truncate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = records.normalize_text(documents(spark, sf_dir), record_id=F.col("doc_id")).where("error_code IS NULL")
    n = big(t.char_count("text"))
    both = texts.select(F.lit("text").alias("kind"), (n + 1).alias("tokens"), n.alias("supervised")).unionByName(chat_tokens(spark, sf_dir).select(F.lit("chat").alias("kind"), "tokens", "supervised"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("samples"), F.sum("tokens").alias("tokens"), F.sum("supervised").alias("supervised"), F.sum(F.least("tokens", F.lit(LENGTHS.train))).alias("kept_tokens"), F.count_if(F.col("tokens") > LENGTHS.train).alias("truncated"))


@query(f"""
WITH n AS (SELECT doc_id, {sql.chars(sql.strip('text'))} + 1 AS tokens FROM documents WHERE {sql.strip('text')} <> '')
SELECT count(*) AS samples, max(tokens) AS max_tokens, (SELECT doc_id FROM n ORDER BY tokens DESC, doc_id LIMIT 1) AS longest_id FROM n
""")
def length_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records.normalize_text(documents(spark, sf_dir), record_id=F.col("doc_id")).where("error_code IS NULL")
    return encode.length_scan(own.withColumn("tokens", big(t.char_count("text")) + 1), "tokens", "doc_id", "doc_id")


#: Weights of the sources that the mixing queries use: every tenth of a list of cases.
WEIGHTS = [0.0, 0.01, 0.25, 0.5, 0.625, 1.0, 1.5, 2.25, 3.0, 0.1]
LIMITS = [None, None, 40, None, 75]
ENTRIES = [(f"src{i}", WEIGHTS[i % 10], LIMITS[i % 5], False if i == 13 else True if i % 2 else None) for i in range(20)]
ENTRIES_SQL = ", ".join(f"('{s}', {w}::DOUBLE, {'NULL' if n is None else n}::BIGINT, {'NULL' if e is None else str(e).lower()}::BOOLEAN)" for s, w, n, e in ENTRIES)
PLAN_SQL = f"""
e(source, weight, sample_limit, enabled) AS (VALUES {ENTRIES_SQL}),
c AS (SELECT source, count(*) AS rows FROM documents GROUP BY source),
b AS (SELECT source, rows, least(rows, coalesce(sample_limit, rows)) AS base, weight FROM c JOIN e USING (source) WHERE enabled IS DISTINCT FROM false),
p AS (
    SELECT source, rows, base, CAST(floor(weight) AS BIGINT) AS copies,
        CASE WHEN weight > floor(weight) AND base > 0 THEN greatest(1, CAST(round_even(base * (weight - floor(weight)), 0) AS BIGINT)) ELSE 0 END AS extra
    FROM b
)
"""


def plans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir), mixing.weights_table(spark, ENTRIES), "source")


@query(f"WITH {PLAN_SQL} SELECT source, rows, base, copies, extra, base * copies + extra AS selected FROM p")
def mix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans_of(spark, sf_dir).withColumn("selected", F.col("base") * F.col("copies") + F.col("extra"))


@query(f"""
WITH {PLAN_SQL},
l AS (SELECT d.source, doc_id, row_number() OVER (PARTITION BY d.source ORDER BY md5('42:limit:' || d.source || ':' || doc_id)) AS n FROM documents d),
k AS (SELECT source, doc_id FROM l JOIN p USING (source) WHERE n <= base),
x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:extra:' || source || ':' || doc_id)) AS n FROM k)
SELECT k.source, doc_id, CAST(i AS INT) AS copy_no FROM k JOIN p USING (source), range(1, copies + 1) r(i)
UNION ALL SELECT x.source, doc_id, 0 FROM x JOIN p USING (source) WHERE n <= extra
""")
def mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("source", "doc_id")
    return mixing.mixed(docs, plans_of(spark, sf_dir), "source", "doc_id", "42").select("source", "doc_id", "copy_no")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id) LIMIT 250")
def sample_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(documents(spark, sf_dir).select("doc_id"), 250, "doc_id", "7")


@query("""
WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || conv_id)) <= 30 AS held FROM c
""")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.split(table(spark, sf_dir, "conversations").select("conv_id").distinct(), 30, "conv_id", "42")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('44:' || doc_id), doc_id) - 1 AS place FROM documents")
def epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shuffled(documents(spark, sf_dir).select("doc_id"), "doc_id", 42, 2)


@query(f"""
WITH m AS (SELECT conv_id, turn, role, {sql.strip('text')} AS content FROM conversations),
u AS (SELECT a.conv_id, a.turn, a.content AS ask, s.content AS context, b.content AS reply
      FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
      LEFT JOIN m s ON s.conv_id = a.conv_id AND s.turn = a.turn - 1 AND s.role = 'system' WHERE a.role = 'user'),
n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS i FROM u WHERE reply <> '')
SELECT conv_id, turn, printf('chat-%06d', i) AS id,
    md5(CASE WHEN coalesce(context, '') <> '' THEN ask || E'\\n\\n补充上下文：\\n' || context ELSE ask END || '|' || reply) AS messages_md5 FROM n
""")
def instruction_to_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.ordering import ordinal

    m = table(spark, sf_dir, "conversations").withColumn("text", t.strip("text"))
    user, reply = m.where("role = 'user'"), m.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    context = m.where("role = 'system'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    own = user.join(reply, ["conv_id", "turn"]).join(context, ["conv_id", "turn"], "left")
    own = own.withColumn("messages", chat.instruction(F.col("text"), F.col("context"), F.col("reply"))).where("messages IS NOT NULL")
    own = ordinal(own, "conv_id", [F.col("conv_id"), F.col("turn")])
    joined = F.array_join(F.transform("messages", lambda x: x["content"]), "|")
    return own.select("conv_id", "turn", F.format_string("chat-%06d", F.col("ordinal") + 1).alias("id"), F.md5(joined).alias("messages_md5"))


@query(f"""
WITH {sql.MESSAGES}, f AS (SELECT conv_id, min_by(role, turn) AS first_role FROM g GROUP BY conv_id)
SELECT conv_id, count(*) AS messages, md5(string_agg(role || ':' || content, '|' ORDER BY turn)) AS messages_md5,
    CASE WHEN any_value(first_role) <> 'user' THEN 'user_not_first' END AS error_code
FROM g JOIN f USING (conv_id) GROUP BY conv_id
""")
def legacy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = good_chats(spark, sf_dir).withColumn("parsed", chat.parse_transcript(chat.prompt(F.col("messages"))))
    joined = F.array_join(F.transform("parsed", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return own.select("conv_id", big(F.size("parsed")).alias("messages"), F.md5(joined).alias("messages_md5"), chat.transcript_error(F.col("parsed")).alias("error_code"))


def chat_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat_tokens(spark, sf_dir).select("conv_id", F.least("tokens", F.lit(2048)).alias("tokens"), "supervised")
    return encode.batched(own, CHAT.batch_size, "conv_id", [F.col("conv_id")])


BINS_SQL = f"""RECURSIVE {sql.CHAT_TOKENS},
o AS (SELECT conv_id, CAST(least(tokens, 2048) AS BIGINT) AS n, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM t),
s AS (SELECT conv_id, n, i // 16 AS batch_no, i % 16 AS batch_pos FROM o),
f AS (
    SELECT conv_id, n, batch_no, batch_pos, 0 AS bin_no, 0 AS bin_pos, CAST(0 AS BIGINT) AS position, n AS used FROM s WHERE batch_pos = 0
    UNION ALL
    SELECT s.conv_id, s.n, s.batch_no, s.batch_pos, f.bin_no + CASE WHEN used + s.n <= 2048 THEN 0 ELSE 1 END, CASE WHEN used + s.n <= 2048 THEN f.bin_pos + 1 ELSE 0 END,
        CASE WHEN used + s.n <= 2048 THEN used ELSE 0 END, CASE WHEN used + s.n <= 2048 THEN used ELSE 0 END + s.n
    FROM f JOIN s ON s.batch_no = f.batch_no AND s.batch_pos = f.batch_pos + 1
)
"""


@query(f"WITH {BINS_SQL} SELECT conv_id, batch_no, batch_pos, n AS tokens, bin_no, bin_pos, position FROM f")
def pack_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat_bins(spark, sf_dir)
    bins = encode.packed(own, "tokens", 2048)
    return own.select("conv_id", "batch_no", "batch_pos").join(bins, ["batch_no", "batch_pos"]).select("conv_id", "batch_no", "batch_pos", big(F.col("tokens")).alias("tokens"), "bin_no", "bin_pos", big(F.col("position")).alias("position"))


@query(f"""
WITH {BINS_SQL},
b AS (SELECT batch_no, bin_no, count(*) AS samples, sum(n) AS used FROM f GROUP BY ALL),
w AS (SELECT *, max(used) OVER (PARTITION BY batch_no) AS longest FROM b)
SELECT batch_no, bin_no, samples, CAST(used AS BIGINT) AS used, CAST(ceil(longest / 8) * 8 AS BIGINT) AS padded FROM w
""")
def pad_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    bins = encode.packed(chat_bins(spark, sf_dir), "tokens", 2048).groupBy("batch_no", "bin_no").agg(F.count(F.lit(1)).alias("samples"), F.sum("tokens").alias("used"))
    return bins.withColumn("padded", big(padded_size(F.max("used").over(Window.partitionBy("batch_no")), LENGTHS.pad_to_multiple_of)))


@query(f"""
WITH {BINS_SQL},
b AS (SELECT batch_no, bin_no, sum(n) AS used, count(*) AS samples FROM f GROUP BY ALL),
q AS (SELECT 'packed' AS mode, batch_no, sum(used) AS active, max(used) * count(*) AS padded, sum(samples) AS samples FROM b GROUP BY batch_no
      UNION ALL SELECT 'plain', batch_no, sum(n), max(n) * count(*), count(*) FROM f GROUP BY batch_no)
SELECT mode, count(*) AS batches, CAST(sum(active) AS BIGINT) AS active_tokens, CAST(sum(padded) AS BIGINT) AS padded_tokens, round(sum(active) / sum(padded), 6) AS utilisation FROM q GROUP BY mode
""")
def pack_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = encode.packed(chat_bins(spark, sf_dir), "tokens", 2048)
    sums = bins.groupBy("batch_no", "bin_no").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("samples"))
    pack = sums.groupBy("batch_no").agg(F.sum("used").alias("active_tokens"), (F.max("used") * F.count(F.lit(1))).alias("padded_tokens"), F.sum("samples").alias("samples"))
    plain = bins.groupBy("batch_no").agg(F.sum("tokens").alias("active_tokens"), (F.max("tokens") * F.count(F.lit(1))).cast("long").alias("padded_tokens"), F.count(F.lit(1)).alias("samples"))
    both = pack.withColumn("mode", F.lit("packed")).unionByName(plain.withColumn("mode", F.lit("plain"))).withColumn("ms", F.lit(1))
    return metrics.throughput(both, "mode").select("mode", "batches", "active_tokens", "padded_tokens", F.round("utilisation", 6).alias("utilisation"))


@query(f"""
WITH {BINS_SQL}
SELECT batch_no, bin_no, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS position_sum, CAST(sum((bin_pos + 1) * n) AS BIGINT) AS segment_sum, CAST(sum(n * (n + 1) / 2) AS BIGINT) AS visible_pairs FROM f GROUP BY ALL
""")
def packed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions restart with each sample, segments count from 1, and a token sees those before it of its segment."""
    bins = encode.packed(chat_bins(spark, sf_dir), "tokens", 2048)
    n = F.col("tokens")
    rows = bins.withColumn("positions", F.sequence(F.lit(0), n - 1)).withColumn("segments", F.array_repeat(F.col("bin_pos") + 1, n))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("batch_no", "bin_no").agg(F.sum(add("positions")).alias("position_sum"), F.sum(add("segments")).alias("segment_sum"), F.sum(add(F.transform("positions", lambda p: p + 1))).alias("visible_pairs"))


@query(f"""
WITH n AS (SELECT doc_id, {sql.chars('text')} AS n FROM documents WHERE {sql.chars('text')} > 0),
s AS (SELECT doc_id, n, sum(n + 1) OVER (ORDER BY doc_id) - n - 1 AS start, (sum(n + 1) OVER ()) // 1024 AS full_ FROM n),
w AS (SELECT unnest(range(CAST(start // 1024 AS BIGINT), CAST((start + n) // 1024 AS BIGINT) + 1)) AS window_no, * FROM s)
SELECT window_no, doc_id, CAST(greatest(window_no * 1024 - start, 0) AS BIGINT) AS first_token,
    CAST(least((window_no + 1) * 1024 - start, n + 1) - greatest(window_no * 1024 - start, 0) AS BIGINT) AS window_tokens
FROM w WHERE window_no < full_
""")
def ppl_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("doc_id", big(t.char_count("text")).alias("tokens"))
    return encode.windows(own, "tokens", 1024, "doc_id", [F.col("doc_id")], "doc_id")


LINES_SQL = f"""
WITH RECURSIVE l AS (
    SELECT doc_id, {sql.strip('x')} AS line, i FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{sql.LINES}')) AS x, generate_subscripts(regexp_split_to_array(text, '{sql.LINES}'), 1) AS i FROM documents)
), k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM l WHERE line <> ''),
f AS (
    SELECT doc_id, i, line, 0 AS grp, length(line) AS used FROM k WHERE i = 1
    UNION ALL
    SELECT k.doc_id, k.i, k.line, grp + CASE WHEN used + 1 + length(k.line) <= 400 THEN 0 ELSE 1 END, CASE WHEN used + 1 + length(k.line) <= 400 THEN used + 1 ELSE 0 END + length(k.line)
    FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1
), g AS (SELECT doc_id, grp, string_agg(line, E'\\n' ORDER BY i) AS text FROM f GROUP BY ALL),
c AS (SELECT doc_id, grp, unnest(range(0, (length(text) - 1) // 400 + 1)) AS part, text FROM g),
d AS (SELECT doc_id, grp, part, CASE WHEN length(text) <= 400 THEN text ELSE {sql.strip('substring(text, CAST(part * 400 + 1 AS BIGINT), 400)')} END AS chunk FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, part) AS INT) AS chunk_no, length(chunk) AS chars, md5(chunk) AS chunk_md5 FROM d WHERE chunk <> ''
"""


@query(LINES_SQL)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode.line_chunks(documents(spark, sf_dir), "text", 400, ["doc_id"])
    return out.select("doc_id", "chunk_no", big(F.char_length("chunk")).alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query(f"""
WITH r AS (SELECT 'documents' AS file, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id, string_agg(role || ': ' || text, E'\\n' ORDER BY turn) FROM conversations GROUP BY conv_id),
n AS (SELECT file, id, {sql.chars('text')} AS a, len(list_filter(string_split(replace(text, E'\\n', E' \\n '), ' '), lambda x: x <> '')) AS b FROM r)
SELECT file, CAST(id AS VARCHAR) AS id, CAST(a AS BIGINT) AS char_tokens, CAST(b AS BIGINT) AS space_tokens, CAST(b - a AS BIGINT) AS delta FROM n
UNION ALL SELECT file, 'total', CAST(sum(a) AS BIGINT), CAST(sum(b) AS BIGINT), CAST(sum(b - a) AS BIGINT) FROM n GROUP BY file
""")
def tokenizer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("role", F.lit(": "), "text")
    chats_ = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), "\n").alias("text"))
    rows = documents(spark, sf_dir).select(F.lit("documents").alias("file"), F.col("doc_id").alias("id"), "text").unionByName(chats_.select(F.lit("conversations").alias("file"), F.col("conv_id").alias("id"), "text"))
    own = rows.select("file", F.col("id").cast("string").alias("id"), big(t.char_count("text")).alias("char_tokens"), big(t.space_count("text")).alias("space_tokens"))
    own = own.withColumn("delta", F.col("space_tokens") - F.col("char_tokens"))
    sums = own.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("char_tokens", "space_tokens", "delta")]).withColumn("id", F.lit("total"))
    return own.unionByName(sums)


@query(f"""
WITH r AS (SELECT page_id, {sql.strip('html')} AS body, {sql.strip('url')} AS title FROM pages)
SELECT page_id, md5(CASE WHEN body <> '' AND title <> '' THEN '标题：' || title || E'\\n\\n正文：\\n' || body WHEN body <> '' THEN body ELSE title END) AS text_md5, nullif(title, '') AS paper_title FROM r
""")
def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(chat.titled_text(F.col("html"), F.col("url"))).alias("text_md5"), t.optional("url").alias("paper_title"))


@query(f"""
WITH x AS ({LINES_SQL})
SELECT printf('docs-%06d', doc_id) || CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN printf('-%04d', chunk_no) ELSE '' END AS id, chunk_md5 FROM x
""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of chunks: of the record alone where it has only one."""
    out = line_chunks(spark, sf_dir)
    chunks = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return out.withColumn("chunks", chunks).select(records.made_id(F.lit("docs"), F.col("doc_id"), F.col("chunk_no"), F.col("chunks")).alias("id"), "chunk_md5")


#: Ids and labels of good conversations by code points, up to 2048, in batches of 16.
ARRAYS_SQL = f"""{BINS_SQL},
seg AS (
    SELECT conv_id, -1 AS turn, 0 AS part, '{sql.BOS}' AS text, false AS sup FROM t
    UNION ALL SELECT conv_id, turn, 0, {sql.LABEL}, false FROM g
    UNION ALL SELECT conv_id, turn, 1, content, role = 'assistant' FROM g
    UNION ALL SELECT conv_id, turn, 2, '{sql.EOS}', true FROM g WHERE role = 'assistant'
),
one AS (SELECT conv_id, turn, part, sup, list_transform(regexp_extract_all(text, '(?s:{sql.SPECIAL}|.)'), lambda x: CASE x WHEN '{sql.BOS}' THEN 1114112 WHEN '{sql.EOS}' THEN 1114113 ELSE unicode(x) END) AS ids FROM seg JOIN t USING (conv_id)),
e AS (
    SELECT conv_id, flatten(list(ids ORDER BY turn, part))[1:2048] AS ids,
        flatten(list(CASE WHEN sup THEN ids ELSE list_transform(ids, lambda x: -100) END ORDER BY turn, part))[1:2048] AS labels
    FROM one GROUP BY conv_id
)
"""


def chat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat_tokens(spark, sf_dir).withColumn("e", chat.encoded(F.col("segments"), 2048)).select("conv_id", "e.input_ids", "e.labels")
    return encode.batched(own, CHAT.batch_size, "conv_id", [F.col("conv_id")])


def arrays_md5(*names: str) -> list[Column]:
    return [F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c) for c in names]


@query(f"""
WITH {ARRAYS_SQL},
w AS (SELECT conv_id, batch_no, ids, labels, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch_no) / 8) * 8 AS BIGINT) AS size FROM s JOIN e USING (conv_id)),
r AS (SELECT *, range(size - len(ids)) AS rest FROM w)
SELECT conv_id, batch_no, size AS padded, md5(array_to_string(ids || list_transform(rest, lambda x: 1114114), ',')) AS input_ids, md5(array_to_string(labels || list_transform(rest, lambda x: -100), ',')) AS labels,
    md5(array_to_string(list_transform(ids, lambda x: 1) || list_transform(rest, lambda x: 0), ',')) AS attention_mask FROM r
""")
def batch_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches padded to a multiple of 8, with labels and masks."""
    out = encode.collated(chat_batches(spark, sf_dir), CHAR.special[t.PAD], 2048, multiple=LENGTHS.pad_to_multiple_of)
    return out.select("conv_id", "batch_no", big(F.size("input_ids")).alias("padded"), *arrays_md5("input_ids", "labels", "attention_mask"))


@query(f"""
WITH {ARRAYS_SQL},
b AS (
    SELECT batch_no, bin_no, flatten(list(ids ORDER BY bin_pos)) AS ids, flatten(list(labels ORDER BY bin_pos)) AS labels,
        flatten(list(CAST(range(n) AS BIGINT[]) ORDER BY bin_pos)) AS positions, flatten(list(list_transform(range(n), lambda x: bin_pos + 1) ORDER BY bin_pos)) AS segments
    FROM f JOIN e USING (conv_id) GROUP BY ALL
),
r AS (SELECT *, range(max(len(ids)) OVER (PARTITION BY batch_no) - len(ids)) AS rest FROM b)
SELECT batch_no, bin_no, CAST(len(ids) AS BIGINT) AS tokens, md5(array_to_string(ids || list_transform(rest, lambda x: 1114114), ',')) AS input_ids, md5(array_to_string(labels || list_transform(rest, lambda x: -100), ',')) AS labels,
    md5(array_to_string(positions || list_transform(rest, lambda x: 0), ',')) AS position_ids, md5(array_to_string(segments || list_transform(rest, lambda x: 0), ',')) AS segment_ids FROM r
""")
def packed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed bins with positions that start again and segments, padded to the longest of their batch."""
    out = encode.collated(chat_batches(spark, sf_dir), CHAR.special[t.PAD], 2048, pack=True)
    tokens = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return out.select("batch_no", "bin_no", big(tokens).alias("tokens"), *arrays_md5("input_ids", "labels", "position_ids", "segment_ids"))


@query(f"""
WITH r AS (SELECT doc_id, {sql.strip('text')} AS text FROM documents),
i AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s:{sql.SPECIAL}|.)'), lambda x: CASE x WHEN '{sql.BOS}' THEN 1114112 WHEN '{sql.EOS}' THEN 1114113 WHEN '{sql.PAD}' THEN 1114114 ELSE unicode(x) END) || [1114113] AS ids FROM r WHERE text <> '')
SELECT doc_id, CAST(least(len(ids), 7680) AS BIGINT) AS tokens, md5(array_to_string(ids[1:7680], ',')) AS input_ids, md5(array_to_string(ids[1:7680], ',')) AS labels, CASE WHEN len(ids) < 2 THEN 'too_few_tokens' END AS error_code FROM i
""")
def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as samples: a text and its end, all supervised, cut at the training length."""
    own = records.normalize_text(documents(spark, sf_dir), record_id=F.col("doc_id")).where("error_code IS NULL")
    own = own.withColumn("e", chat.encoded(chat.text_segments(F.col("text")), LENGTHS.train)).select("doc_id", "e.input_ids", "e.labels")
    return own.select("doc_id", big(F.size("input_ids")).alias("tokens"), *arrays_md5("input_ids", "labels"), chat.too_short(F.col("input_ids")).alias("error_code"))


@query("""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
w AS (SELECT doc_id, i, i + CAST(floor(CAST('0x' || left(md5('9:' || doc_id), 8) AS BIGINT) / 4294967296.0 * 2048) AS BIGINT) AS due FROM o)
SELECT doc_id, row_number() OVER (ORDER BY due, i) - 1 AS place FROM w
""")
def buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.buffer_shuffled(documents(spark, sf_dir).select("doc_id"), "doc_id", LENGTHS.shuffle_buffer, "9").select("doc_id", "place")


@query("""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
s AS (SELECT *, md5('9:' || i) AS key, CASE WHEN i < 128 THEN i ELSE CAST(floor(CAST('0x' || left(md5('9:' || i), 8) AS BIGINT) / 4294967296.0 * 128) AS BIGINT) END AS slot FROM o),
w AS (SELECT *, lead(i) OVER (PARTITION BY slot ORDER BY i) AS next FROM s)
SELECT doc_id, CASE WHEN next IS NOT NULL THEN next - 128 ELSE greatest(n - 128, 0) + row_number() OVER (PARTITION BY next IS NULL ORDER BY key, i) - 1 END AS place FROM w
""")
def slot_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.slot_shuffled(documents(spark, sf_dir).select("doc_id"), "doc_id", 128, "9").select("doc_id", "place")


@query(f"""
WITH c AS (SELECT conv_id, list({{'role': role, 'content': {sql.strip('text')}}} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id),
r AS (
    SELECT CASE WHEN doc_id % 17 = 0 THEN 'note' WHEN doc_id % 19 = 0 THEN NULL ELSE ' text ' END AS type, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE 'd' || doc_id END AS id, doc_id AS line, text, NULL AS ms, source FROM documents
    UNION ALL SELECT 'chat', CASE WHEN conv_id % 7 <> 0 THEN 'c' || conv_id END, conv_id, NULL, ms, NULL FROM c
),
n AS (SELECT trim(type) AS type, coalesce(nullif(trim(id), ''), 'line:' || line) AS id, {sql.strip('text')} AS text, ms, coalesce(nullif({sql.strip('source')}, ''), 'mixed') AS source, 'train' AS split FROM r)
SELECT type, id, source, split, CASE WHEN type = 'text' THEN md5(text) END AS text_md5, CAST(CASE WHEN type = 'chat' THEN len(ms) END AS BIGINT) AS messages,
    CASE WHEN type IS NULL OR type NOT IN ('text', 'chat') THEN 'type_unknown' WHEN type = 'text' AND text IS NULL THEN 'text_missing' WHEN type = 'text' AND text = '' THEN 'text_blank'
         WHEN type = 'chat' AND len(list_filter(ms, lambda m: coalesce(m.role NOT IN ('system', 'user', 'assistant', 'observation'), true))) > 0 THEN 'role_unknown'
         WHEN type = 'chat' AND len(list_filter(ms, lambda m: coalesce(m.content = '', true))) > 0 THEN 'content_blank' END AS error_code
FROM n
""")
def record_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of mixed types, each record by the rules of its type; ids and fields that lack get defaults."""
    key = F.col("doc_id")
    kind = F.when(key % 17 == 0, "note").when(key % 19 == 0, None).otherwise(" text ")
    own = F.when(key % 5 == 0, "  ").otherwise(F.concat(F.lit("d"), key.cast("string")))
    texts = documents(spark, sf_dir).select(kind.alias("type"), own.alias("id"), key.alias("line"), "text", F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"), "source")
    conv = chats(spark, sf_dir).select(F.lit("chat").alias("type"), F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("id"), F.col("conv_id").alias("line"), F.lit(None).cast("string").alias("text"), "messages", F.lit(None).cast("string").alias("source"))
    out = records.with_defaults(records.dispatched(texts.unionByName(conv), F.concat(F.lit("line:"), F.col("line").cast("string"))), source="mixed", split="train")
    return out.select("type", "id", "source", "split", F.md5("text").alias("text_md5"), big(F.size("messages")).alias("messages"), "error_code")


@query(f"""
WITH r AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM r)
SELECT n AS line_no, n - 1 AS record_index, 'docs:' || n AS default_id, md5(text) AS text_md5, 'corpus' AS source, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, CAST(1 AS BIGINT) AS others FROM o
""")
def raw_text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a folder of JSONL files (in order of ids), read back as raw texts: numbers over all files, the rest of the payload, defaults."""
    path = f"{scratch(spark)}/docs"
    own = documents(spark, sf_dir).where("text IS NOT NULL").select(F.col("text").alias("content"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "test").alias("split"))
    writers.in_order(own, path, "doc_id")
    out = readers.raw_texts(spark, path, source="corpus", split="train")
    others = F.size(F.map_filter("payload", lambda k, _: k != "split"))
    n = big(F.col("n"))
    return out.select(n.alias("line_no"), (n - 1).alias("record_index"), F.concat(F.lit("docs:"), n.cast("string")).alias("default_id"), F.md5("text").alias("text_md5"), "source", "split", big(others).alias("others"))


@query(f"""
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
u AS (SELECT a.conv_id, a.turn, {sql.strip('a.text')} AS ask, {sql.strip('b.text')} AS reply, row_number() OVER (ORDER BY a.conv_id, a.turn) AS n
      FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user' AND {sql.strip('a.text')} <> '')
SELECT printf('turns-%06d', n) AS id, 'turns' AS source, CASE WHEN reply <> '' THEN md5(ask || '|' || reply) END AS messages_md5 FROM u
""")
def instruction_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a folder of instruction JSONL files, read back as chats."""
    path = f"{scratch(spark)}/turns"
    m = table(spark, sf_dir, "conversations")
    reply = m.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    own = m.where("role = 'user'").where(t.strip("text") != "").join(reply, ["conv_id", "turn"])
    writers.in_order(own.select("conv_id", "turn", F.col("text").alias("instruction"), "response", F.lit("chat").alias("category")), path, "conv_id", "turn")
    joined = F.array_join(F.transform("messages", lambda x: x["content"]), "|")
    return readers.instructions(spark, path, "turns").select("id", "source", F.md5(joined).alias("messages_md5"))


@query(f"""
WITH i AS (
    SELECT doc_id, list_transform(regexp_extract_all(text, '(?s:{sql.SPECIAL}|.)'), lambda x: CASE x WHEN '{sql.BOS}' THEN 1114112 WHEN '{sql.EOS}' THEN 1114113 WHEN '{sql.PAD}' THEN 1114114 ELSE unicode(x) END) AS ids
    FROM documents WHERE text <> ''
), a AS (SELECT doc_id, k, unnest(list_append(ids, 1114113)) AS id, generate_subscripts(list_append(ids, 1114113), 1) AS j FROM (SELECT doc_id, ids, row_number() OVER (ORDER BY doc_id) AS k FROM i)),
p AS (SELECT id, row_number() OVER (ORDER BY k, j) - 1 AS place, count(*) OVER () // 1024 AS full_ FROM a)
SELECT place // 1024 AS window_no, count(*) AS size, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY place)) AS ids_md5 FROM p WHERE place // 1024 < full_ GROUP BY ALL
""")
def ppl_id_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the windows themselves."""
    own = documents(spark, sf_dir).select("doc_id", "text")
    out = encode.id_windows(own, CHAR.ids(F.col("text")), CHAR.special[t.EOS], 1024, "doc_id", [F.col("doc_id")], tokens=t.char_count("text"))
    return out.select("window_no", big(F.size("ids")).alias("size"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query(f"""
WITH {BINS_SQL},
x AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY batch_no, bin_no ORDER BY bin_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM f),
q AS (SELECT batch_no, bin_no, start, unnest(range(start, start + CAST(n AS BIGINT))) AS q FROM x),
k AS (SELECT batch_no, bin_no, q, unnest(range(start, q + 1)) AS k FROM q)
SELECT batch_no, bin_no, q // 128 AS query_block, k // 128 AS key_block, count(*) AS visible, CASE WHEN count(*) = 128 * 128 THEN 'full' ELSE 'edge' END AS kind FROM k GROUP BY ALL
""")
def packed_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block pairs that attention sees in packed bins; the SQL expands the mask."""
    bins = encode.packed(chat_bins(spark, sf_dir), "tokens", 2048)
    return encode.visible_blocks(bins, ["batch_no", "bin_no"], "position", "tokens", 128)


@query(f"""
WITH r AS (
    SELECT doc_id AS id, 'text' AS kind, text AS x FROM documents WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, 'sorted', '{{"a": {{"k": ' || doc_id || ', "z": [1, {{"b": null, "y": true}}]}}, "lang": ' || to_json(lang) || ', "source": ' || to_json(source) || '}}' FROM documents WHERE doc_id % 4 = 1
    UNION ALL SELECT doc_id, 'usual', {sql.strip('source')} || E'\n' || {sql.strip('lang')} FROM documents WHERE doc_id % 4 = 2
    UNION ALL SELECT doc_id, 'string', text FROM documents WHERE doc_id % 4 = 3
    UNION ALL SELECT conv_id, 'messages', string_agg({sql.strip('role')} || ': ' || {sql.strip('text')}, E'\n' ORDER BY turn) FROM conversations WHERE {sql.strip('text')} <> '' GROUP BY conv_id
)
SELECT id, kind, md5(x) AS text_md5, CAST({sql.chars('x')} AS BIGINT) AS tokens FROM r WHERE x IS NOT NULL
""")
def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is counted of records of any shape."""
    docs, k = documents(spark, sf_dir).where("text IS NOT NULL"), F.col("doc_id")
    nested = F.concat(F.lit('{"source": '), F.expr("substring(to_json(named_struct('v', source)), 6, length(to_json(named_struct('v', source))) - 6)"), F.lit(', "lang":'), F.expr("substring(to_json(named_struct('v', lang)), 6, length(to_json(named_struct('v', lang))) - 6)"), F.lit(', "a": {"z": [1, {"y": true, "b": null}], "k": '), k.cast("string"), F.lit("}}"))
    usual = F.to_json(F.struct(F.col("lang").alias("content"), F.col("source").alias("instruction"), F.lit(" ").alias("output"), F.lit(3).alias("input")))
    line = F.when(k % 4 == 0, F.to_json(F.struct("text", F.lit("no").alias("content")))).when(k % 4 == 1, nested).when(k % 4 == 2, usual)
    line = F.coalesce(line, F.expr("substring(to_json(named_struct('v', text)), 6, length(to_json(named_struct('v', text))) - 6)"))
    kind = F.when(k % 4 == 0, "text").when(k % 4 == 1, "sorted").when(k % 4 == 2, "usual").otherwise("string")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    rows = docs.select(k.alias("id"), kind.alias("kind"), line.alias("line")).unionByName(talks.select(F.col("conv_id").alias("id"), F.lit("messages").alias("kind"), F.to_json(F.struct("messages")).alias("line")))
    out = rows.select("id", "kind", records.counting_text(F.parse_json("line")).alias("x"))
    return out.select("id", "kind", F.md5("x").alias("text_md5"), big(t.char_count("x")).alias("tokens"))


@query()
def token_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole lines up to 256 tokens of a library's file; no SQL has its ids."""
    import public_tokenizers

    out = encode.token_line_chunks(documents(spark, sf_dir), "text", 256, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "chunk_no", big(F.char_length("chunk")).alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query(f"""
WITH o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents)
SELECT CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE printf('docs-%06d', n) END AS id, md5({sql.strip('text')}) AS text_md5, lang AS language, doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'docs' END AS source, 'train' AS split
FROM o WHERE {sql.strip('text')} <> ''
""")
def converted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as several raw files, through the converter and its sink, and read again: payload and language are kept, ids are unique over files."""
    folder, k = scratch(spark), F.col("doc_id")
    own = documents(spark, sf_dir).select(k, F.col("text").alias("content"), F.col("lang").alias("language"), k.alias("doc"), F.when(k % 3 == 0, F.concat(F.lit("d"), k.cast("string"))).alias("id"), F.when(k % 2 == 0, "even").alias("source"))
    writers.in_order(own, f"{folder}/raw", "doc_id")
    convert.raw_text(spark, f"{folder}/raw", f"{folder}/out", "docs")
    out = spark.read.schema("id string, text string, language string, doc long, source string, split string").json(f"{folder}/out")
    return out.select("id", F.md5("text").alias("text_md5"), "language", "doc", "source", "split")


@query(f"""
WITH x AS ({LINES_SQL})
SELECT printf('docs-%06d', n) || CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN printf('-%04d', chunk_no) ELSE '' END AS id, chunk_md5
FROM x JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) USING (doc_id)
""")
def converted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Parquet files, five or as many as splits that they are read in, converted in chunks of 400 characters."""
    folder, own = scratch(spark), documents(spark, sf_dir).select("doc_id", "text")
    own.repartitionByRange(max(5, own.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{folder}/p")
    convert.parquet(spark, f"{folder}/p", f"{folder}/out", "docs", most=400)
    return spark.read.schema("id string, text string").json(f"{folder}/out").select("id", F.md5("text").alias("chunk_md5"))


@query(f"""
WITH a AS (
    SELECT {sql.strip('a.text')} AS ask, {sql.strip('b.text')} AS reply, row_number() OVER (ORDER BY a.conv_id, a.turn) AS n
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user' AND {sql.strip('a.text')} <> ''
), g AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || n)) AS pick FROM a WHERE reply <> '')
SELECT printf('turns-%06d', n) AS id, pick <= 20 AS held, md5(ask || '|' || reply) AS messages_md5 FROM g
""")
def converted_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as instruction files, converted into chats, 20 of them held out."""
    folder, m = scratch(spark), table(spark, sf_dir, "conversations")
    reply = m.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    own = m.where("role = 'user'").where(t.strip("text") != "").join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("instruction"), "response")
    writers.in_order(own, f"{folder}/raw", "conv_id", "turn")
    convert.instructions(spark, f"{folder}/raw", f"{folder}/kept", "turns", held=20, held_output=f"{folder}/held", seed="7")
    read = lambda name: spark.read.schema("id string, messages array<struct<role:string,content:string>>").json(f"{folder}/{name}").withColumn("held", F.lit(name == "held"))
    joined = F.array_join(F.transform("messages", lambda x: x["content"]), "|")
    return read("kept").unionByName(read("held")).select("id", "held", F.md5(joined).alias("messages_md5"))


@query("""
WITH w(source, weight, most) AS (VALUES ('en', 0.5, NULL), ('fr', 2.25, NULL), ('de', 1.0, 20), ('es', 1.3, 33)),
n AS (SELECT lang AS source, count(*) AS n FROM documents GROUP BY ALL),
b AS (SELECT source, weight, least(n, coalesce(most, n)) AS base FROM n JOIN w USING (source)),
e AS (SELECT source, base, CAST(floor(weight) AS BIGINT) AS copies, CASE WHEN weight > floor(weight) THEN greatest(1, CAST(round_even(base * (weight - floor(weight)), 0) AS BIGINT)) ELSE 0 END AS extra FROM b)
SELECT source, base * copies + extra AS records, CASE WHEN copies > 0 THEN base ELSE extra END AS distinct_records, copies + CASE WHEN extra > 0 THEN 1 ELSE 0 END AS most_copies FROM e
""")
def manifest_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language as corpora of a manifest, mixed by weights and limits through the data source. Which records a share has is the source's choice."""
    folder = scratch(spark)
    documents(spark, sf_dir).select("lang", F.to_json(F.struct("doc_id", "text")).alias("value")).write.partitionBy("lang").text(folder + "/corpora")
    entries = [{"name": n, "path": f"corpora/lang={n}", "weight": w, "sample_limit": m} for n, w, m in (("en", 0.5, None), ("fr", 2.25, None), ("de", 1.0, 20), ("es", 1.3, 33))]
    manifest = F.to_json(F.struct(F.array(*[F.struct(F.lit(e["name"]).alias("name"), F.lit(e["path"]).alias("path"), F.lit(e["weight"]).alias("weight"), F.lit(e["sample_limit"]).cast("long").alias("sample_limit")) for e in entries]).alias("datasets")))
    spark.range(1).coalesce(1).select(manifest.alias("value")).write.text(folder + "/manifest")
    own = mixture.load(spark, folder + "/manifest", base=folder, columns=["source", "record_index", "copy_no"])
    out = own.groupBy("source", "record_index").agg(F.count(F.lit(1)).alias("copies"))
    return out.groupBy("source").agg(F.sum("copies").alias("records"), F.count(F.lit(1)).alias("distinct_records"), F.max("copies").alias("most_copies"))


@query(f"""
SELECT CASE WHEN text IS NULL THEN 'text_missing' WHEN {sql.strip('text')} = '' THEN 'text_blank' WHEN n_chars < 200 THEN 'short' ELSE 'converted' END AS outcome, count(*) AS records FROM documents GROUP BY ALL
""")
def sink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the committing sink counts, and what the files have that it wrote in the same pass."""
    path = f"{scratch(spark)}/out"
    own = records.normalize_text(documents(spark, sf_dir), record_id=F.col("doc_id"))
    code = F.coalesce("error_code", F.when(F.col("n_chars") < 200, "short"))
    sink.save(own.select(F.to_json(F.struct("id", "text")).alias("value"), code.alias("error_code")), path)
    good = spark.read.text(path).select(F.lit("converted").alias("outcome"))
    bad = spark.read.schema("error_code string").json(f"{path}/_skipped").select(F.col("error_code").alias("outcome"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


@query(f"""
WITH x AS (SELECT conv_id, turn, CAST({sql.chars('text')} AS BIGINT) AS tokens FROM conversations WHERE text IS NOT NULL),
s AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS total, row_number() OVER w AS turns FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CAST(turn AS BIGINT) AS turn, tokens, total, turns, total > 512 AND total - tokens <= 512 AS crossed FROM s
""")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream of files in three steps; the state of each conversation goes from step to step."""
    folder = scratch(spark)
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", big(t.char_count("text")).alias("tokens"))
    for step in range(3):
        part = F.least(F.lit(2), F.floor(F.col("turn") / 2))
        turns.where(part == step).coalesce(2).write.mode("append").parquet(f"{folder}/turns")
        sessions.follow(spark, f"{folder}/turns", f"{folder}/out", f"{folder}/checkpoint", 512).awaitTermination()
    return spark.read.schema(sessions.OUT).parquet(f"{folder}/out")
