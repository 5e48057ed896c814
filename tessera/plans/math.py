"""Queries of training and evaluation arithmetic, decoding, cases for long contexts and plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import options
from tessera.functions import ids
from tessera.functions.ids import IGNORED
from tessera.functions import text as t
from tessera.operators import chat, configs, decoding, longctx, metrics, planning
from tessera.operators.ordering import ordinal

from . import sql
from .corpus import documents, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(c: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(t.col(c), digits).alias(name)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training batches: 500 to an epoch, a loss, tokens, samples."""
    own = ordinal(table(spark, sf_dir, "events"), "event_id", [F.col("event_id")])
    own = own.withColumn("epoch", F.floor(F.col("ordinal") / 500)).withColumn("batch", F.col("ordinal") % 500 + 1)
    return own.select("event_id", "epoch", "batch", "event_type", F.abs(F.coalesce("value", F.lit(0.0))).alias("loss"), (F.col("event_id") % 7 * 10 + 5).alias("tokens"), (F.col("event_id") % 3 + 1).alias("samples"))


BATCHES = """
o AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
e AS (SELECT event_id, i // 500 AS epoch, i % 500 + 1 AS batch, event_type, abs(coalesce(value, 0)) AS loss, event_id % 7 * 10 + 5 AS tokens, event_id % 3 + 1 AS samples FROM o)
"""


@query(f"""
WITH {BATCHES}, s AS (SELECT epoch, count(*) AS batches, CAST(sum(tokens) AS BIGINT) AS tokens, sum(loss) / sum(tokens) AS l FROM e GROUP BY epoch)
SELECT epoch, batches, tokens, round(l, 6) AS eval_loss, round(CASE WHEN l < 80 THEN exp(l) ELSE 'inf'::DOUBLE END, 5) AS eval_ppl FROM s
""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.evaluation(batches(spark, sf_dir), ["epoch"], "loss", "tokens")
    return out.select("epoch", "batches", "tokens", rounded("eval_loss", "eval_loss"), rounded("eval_ppl", "eval_ppl", 5))


@query(f"""
WITH {BATCHES}, s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 1024 ELSE 2048 END AS window_size, count(*) AS windows, CAST(sum(tokens) AS BIGINT) AS tokens, sum(loss) / sum(tokens) AS l FROM e GROUP BY 1)
SELECT window_size, windows, tokens, round(l, 6) AS avg_nll, round(CASE WHEN l <= 80 THEN exp(l) END, 5) AS ppl FROM s
""")
def ppl_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = batches(spark, sf_dir).withColumn("window_size", F.when(F.col("event_id") % 2 == 0, 1024).otherwise(2048))
    return metrics.window_perplexity(own, "window_size", "loss", "tokens").select("window_size", "windows", "tokens", rounded("avg_nll", "avg_nll"), rounded("ppl", "ppl", 5))


@query(f"""
WITH {BATCHES}
SELECT epoch, (batch - 1) // 4 AS step, count(*) AS batches, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(loss), 6) AS mean_loss FROM e GROUP BY ALL
""")
def grad_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accumulated(batches(spark, sf_dir), "epoch", "batch", 4, "loss", "tokens").select("epoch", "step", "batches", "tokens", rounded("mean_loss", "mean_loss"))


@query(f"""
WITH {BATCHES}
SELECT epoch, CAST(ceil(batch / 10) AS BIGINT) AS log_no, max(batch) AS last_step, count(*) AS steps, round(avg(loss), 6) AS mean_loss, round(avg(tokens), 6) AS mean_tokens FROM e GROUP BY ALL
""")
def log_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.logged(batches(spark, sf_dir), "epoch", "batch", options.Training().log_interval, ["loss", "tokens"])
    return out.select("epoch", "log_no", "last_step", "steps", rounded("mean_loss", "mean_loss"), rounded("mean_tokens", "mean_tokens"))


@query(f"""
WITH {BATCHES}
SELECT event_id, CAST(sum(tokens) OVER (ORDER BY event_id) AS BIGINT) AS tokens_seen, CAST(sum(samples) OVER (ORDER BY event_id) AS BIGINT) AS samples_seen FROM e
""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_totals(batches(spark, sf_dir), "event_id", [F.col("event_id")], ["tokens", "samples"]).select("event_id", "tokens_seen", "samples_seen")


@query(f"""
WITH {BATCHES}
SELECT epoch, event_type, metric, round(sum(value), 4) AS total FROM (
    SELECT epoch, event_type, 'loss' AS metric, CAST(loss AS DOUBLE) AS value FROM e UNION ALL SELECT epoch, event_type, 'tokens', tokens FROM e UNION ALL SELECT epoch, event_type, 'samples', samples FROM e
) GROUP BY ALL
""")
def metric_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.scalars(batches(spark, sf_dir), ["epoch", "event_type"], ["loss", "tokens", "samples"])
    return own.groupBy("epoch", "event_type", "metric").agg(F.round(F.sum("value"), 4).alias("total"))


@query(f"""
WITH {BATCHES}, s AS (SELECT event_type, count(*) AS batches, round(sum(loss) / sum(tokens), 4) AS loss FROM e GROUP BY event_type)
SELECT E'| event_type | batches | loss |\\n|---|---|---|\\n' || string_agg('| ' || event_type || ' | ' || batches || ' | ' || printf('%.4f', loss) || ' |', E'\\n' ORDER BY event_type) AS markdown FROM s
""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = batches(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("batches"), F.format_string("%.4f", F.round(F.sum("loss") / F.sum("tokens"), 4)).alias("loss"))
    return metrics.markdown_table(own, ["event_type", "batches", "loss"], "event_type")


@query(f"""
WITH RECURSIVE c(case_no, target, depth, seed) AS (VALUES (0, 2048, 0.2::DOUBLE, 42), (1, 2048, 0.5, 43), (2, 2048, 0.8, 44), (3, 4096, 0.2, 45), (4, 4096, 0.5, 46), (5, 4096, 0.8, 47)),
a AS (SELECT *, printf('NIAH-%04d-%02d', seed, CAST(trunc(depth * 100) AS INT)) AS answer FROM c),
b AS (SELECT *, '隐藏针：本段资料唯一需要记住的代号是 ' || answer || '。' AS needle, '问题：隐藏针中的代号是什么？请只输出代号。' AS question FROM a),
p AS (SELECT b.*, CAST(i AS INT) AS i, printf('段落%04d：研究人员围绕', i) || (['古籍整理', '植物观察', '课堂讨论', '档案编目', '城市地理', '数学笔记', '物理实验', '历史摘录'])[i % 8 + 1] || (['记录', '整理', '分析', '讨论', '归纳', '标注', '复核', '补充'])[i * 3 % 8 + 1]
    || '样本，补充了编号为' || (100 + {sql.UNIFORM.format("md5(seed || ':' || i)")} % 900) || '的说明，并强调需要保持上下文顺序稳定。' AS text FROM b, range(1, 121) r(i)),
s AS (SELECT *, length(needle || E'\\n' || question || E'\\n') + coalesce(sum(length(text) + 1) OVER (PARTITION BY case_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS size FROM p),
k AS (SELECT *, count(*) OVER (PARTITION BY case_no) AS n FROM s WHERE size < target),
j AS (SELECT case_no, i AS place, 0 AS sub, text, answer, question, target FROM k UNION ALL SELECT DISTINCT case_no, least(n, CAST(trunc(n * depth) AS INT)), 1, needle, answer, question, target FROM k)
SELECT case_no, any_value(answer) AS expected_answer, length({"any_value(question)"}) > 0 AS asked,
    md5('{sql.BOS}' || E'\\n\\nUser: ' || E'下面是一段很长的资料，请先通读，再回答最后的问题。\\n\\n' || string_agg(text, E'\\n' ORDER BY place, sub) || E'\\n\\n' || any_value(question) || E'\\n\\nAssistant: ') AS prompt_md5
FROM j GROUP BY case_no
""")
def needle_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = longctx.needle_cases(longctx.grid(spark, [2048, 4096], [0.2, 0.5, 0.8], 42))
    return out.select("case_no", "expected_answer", F.contains("prompt_text", F.lit(longctx.NEEDLE_QUESTION)).alias("asked"), F.md5("prompt_text").alias("prompt_md5"))


@query(f"""
WITH c(case_no, target, seed) AS (VALUES (0, 2048, 1042), (1, 4096, 1043)),
a AS (SELECT *, 8 + {sql.UNIFORM.format("md5('retrieval:' || seed)")} % 25 AS asked FROM c),
b AS (SELECT *, printf('问题：档案 A%03d 的密钥是什么？请只输出密钥。', asked) AS question FROM a),
p AS (SELECT b.*, i, printf('档案 A%03d：城市=', i) || (['上海', '北京', '广州', '深圳', '成都', '武汉'])[i % 6 + 1] || '；颜色=' || (['红', '蓝', '绿', '黄', '紫', '灰'])[i % 6 + 1] || printf('；密钥=KEY-%04d-%03d。', seed, i) AS text FROM b, range(1, 161) r(i)),
s AS (SELECT *, 1 + length(E'\\n\\nUser: 下面是一个很长的档案目录，请根据目录回答最后的问题。\\n\\n' || E'\\n\\n' || question || E'\\n\\nAssistant: ') + coalesce(sum(length(text) + 1) OVER (PARTITION BY case_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS size FROM p)
SELECT case_no, any_value(printf('KEY-%04d-%03d', seed, asked)) AS expected_answer, max(i) >= any_value(asked) AS answerable,
    md5('{sql.BOS}' || E'\\n\\nUser: 下面是一个很长的档案目录，请根据目录回答最后的问题。\\n\\n' || string_agg(text, E'\\n' ORDER BY i) || E'\\n\\n' || any_value(question) || E'\\n\\nAssistant: ') AS prompt_md5
FROM s WHERE size < target OR i = 1 GROUP BY case_no
""")
def retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(0, 2048, 1042), (1, 4096, 1043)], "case_no int, target int, seed int")
    out = longctx.retrieval_cases(grid)
    return out.select("case_no", "expected_answer", F.contains("prompt_text", F.col("expected_answer")).alias("answerable"), F.md5("prompt_text").alias("prompt_md5"))


#: Predictions are documents, expected answers the first words of benchmark items in turn.
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.substring_index("text", " ", 3).alias("expected"))
    count = items.agg(F.count(F.lit(1)).alias("n"))  # items are numbered from 0
    own = documents(spark, sf_dir).crossJoin(F.broadcast(count)).withColumn("item_id", F.col("doc_id") % F.col("n")).drop("n")
    own = own.join(items, "item_id").withColumn("matched", longctx.matched("text", "expected"))
    return own.select("doc_id", "item_id", "lang", "matched", F.when(F.col("doc_id") % 11 == 0, "error").otherwise("ok").alias("status"), (F.col("n_chars") / 1000).alias("latency"))


ANSWERS = f"""
a AS (SELECT doc_id, item_id, d.lang, contains({sql.answer('d.text')}, {sql.answer("array_to_string(string_split(b.text, ' ')[1:3], ' ')")}) AS matched,
    CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, n_chars / 1000 AS latency
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
"""


@query(f"WITH {ANSWERS} SELECT doc_id, item_id, matched FROM a")
def answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", "item_id", "matched")


@query(f"""
WITH {ANSWERS}
SELECT lang, count(*) AS samples, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status <> 'ok') AS failed,
    round(count(*) FILTER (status = 'ok' AND matched) / count(*), 6) AS exact_match_rate, round(avg(latency) FILTER (status = 'ok'), 6) AS avg_latency
FROM a GROUP BY lang
""")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.generation_rates(answers(spark, sf_dir), ["lang"])
    return out.select("lang", "samples", "succeeded", "failed", rounded("exact_match_rate", "exact_match_rate"), rounded("avg_latency", "avg_latency"))


@query("""
WITH r AS (SELECT vec_id, unnest(embedding)::DOUBLE / 0.7 AS x, generate_subscripts(embedding, 1) - 1 AS token_id FROM embeddings),
k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS rk, max(x) OVER (PARTITION BY vec_id) AS top FROM r),
p AS (SELECT vec_id, token_id, exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY vec_id) AS prob FROM k WHERE rk <= 20),
c AS (SELECT *, sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, token_id ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, token_id) AS n FROM p),
n AS (SELECT vec_id, token_id, prob / greatest(sum(prob) OVER (PARTITION BY vec_id), 1e-12) AS prob FROM c WHERE s <= 0.83 OR n = 1)
SELECT vec_id, token_id, round(prob, 6) AS prob FROM n
""")
def nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoding.token_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return decoding.nucleus(rows, "vec_id", 0.7, 20, 0.83).select("vec_id", F.col("token_id").cast("long").alias("token_id"), rounded("prob", "prob"))


@query(f"""
WITH r AS (SELECT vec_id, exp(unnest(embedding)::DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS token_id FROM embeddings),
p AS (SELECT vec_id, token_id, sum(x) OVER (PARTITION BY vec_id ORDER BY token_id) / sum(x) OVER (PARTITION BY vec_id) AS s FROM r),
u AS (SELECT vec_id, {sql.UNIFORM.format("md5('5:' || vec_id)")} / 4294967296 AS u FROM embeddings)
SELECT vec_id, coalesce(min(token_id) FILTER (s > u), max(token_id)) AS token_id FROM p JOIN u USING (vec_id) GROUP BY vec_id
""")
def multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoding.nucleus(decoding.token_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", 1.0, 0, 2.0)
    return decoding.drawn(rows, "vec_id", "5").select("vec_id", F.col("token_id").cast("long").alias("token_id"))


@query("""
WITH h AS (SELECT vec_id, embedding, [vec_id % 64, (vec_id * 7) % 64, (vec_id * 13) % 64, (vec_id + 5) % 64] AS history FROM embeddings),
r AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS token_id, history[2:4] AS recent FROM h),
p AS (SELECT vec_id, token_id, CASE WHEN list_contains(recent, token_id) THEN CASE WHEN x > 0 THEN x / 1.3 ELSE x * 1.3 END ELSE x END AS x FROM r)
SELECT vec_id, (SELECT token_id FROM p q WHERE q.vec_id = p.vec_id AND token_id <> 3 ORDER BY x DESC, token_id LIMIT 1) AS next_id, round(sum(x), 5) AS logit_sum FROM p GROUP BY vec_id
""")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    own = table(spark, sf_dir, "embeddings").withColumn("history", F.array(v % 64, v * 7 % 64, v * 13 % 64, (v + 5) % 64).cast("array<int>"))
    own = own.withColumn("logits", decoding.penalized(F.col("embedding").cast("array<double>"), F.col("history"), 1.3, 3))
    return own.select("vec_id", decoding.argmax(F.col("logits"), pad=3).cast("long").alias("next_id"), F.round(F.aggregate("logits", F.lit(0.0), lambda a, x: a + x), 5).alias("logit_sum"))


@query("""
WITH f AS (SELECT vec_id, list_transform(embedding[1:CAST(vec_id % 4 AS INT)], lambda x: round(1 + abs(x::DOUBLE) * (vec_id % 2), 4)) AS f FROM embeddings)
SELECT vec_id, len(f) AS count, len(list_distinct(f)) AS unique_count, list_min(f) AS min, list_max(f) AS max,
    CASE WHEN len(f) = 0 THEN 'missing' WHEN len(list_distinct(f)) = 1 THEN 'uniform' ELSE 'per_dimension' END AS mode, CASE WHEN len(list_distinct(f)) = 1 THEN f[1] END AS uniform_value
FROM f
""")
def factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.transform(F.slice("embedding", F.lit(1), (F.col("vec_id") % 4).cast("int")), lambda x: F.round(1 + F.abs(x.cast("double")) * (F.col("vec_id") % 2), 4))
    own = table(spark, sf_dir, "embeddings").select("vec_id", metrics.factor_summary(f).alias("s")).select("vec_id", "s.*")
    return own.withColumns({c: F.col(c).cast("long") for c in ("count", "unique_count")})


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(metrics.norm(F.col("embedding")), "norm"))


@query("""
WITH s AS (SELECT i AS step FROM range(0, 750) r(i))
SELECT step, round(0.0003 * CASE WHEN step < 37 THEN step / 37 ELSE greatest(0, 0.5 * (1 + cos(pi() * (step - 37) / 713))) END, 10) AS lr FROM s
""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.learning_rates(spark, 1000, 4, 3, 0.05, 3e-4).select("step", rounded("lr", "lr", 10))


@query(f"""
WITH u AS (SELECT event_id, {sql.UNIFORM.format("md5('9:' || event_id)")} / 4294967296 AS u FROM events)
SELECT event_id, CASE WHEN u < 0.5 THEN 1024 WHEN u < 0.75 THEN 2048 ELSE 7680 END AS window_length FROM u
""")
def window_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.window_choice(table(spark, sf_dir, "events").select("event_id"), "event_id", [1024, 2048, 4096, 7680], [2.0, 1.0, 0.0, 1.0], "9")


def layers(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").alias("layer"), F.when(F.col("id") % 4 == 2, "retnet").otherwise("attention").alias("block_type"))


LAYERS = "l AS (SELECT i AS layer, CASE WHEN i % 4 = 2 THEN 'retnet' ELSE 'attention' END AS block_type FROM range(0, 24) r(i))"


@query(f"""
WITH {LAYERS}, n AS (SELECT *, row_number() OVER (PARTITION BY block_type ORDER BY layer) - 1 AS nth, CAST(ceil(sum(CASE WHEN block_type = 'attention' THEN 1 ELSE 0 END) OVER () / 2) AS BIGINT) AS groups FROM l),
g AS (SELECT layer, block_type, CASE WHEN block_type = 'attention' THEN nth // 2 ELSE groups + nth END AS group_id FROM n), f AS (SELECT *, min(layer) OVER (PARTITION BY group_id) AS first FROM g)
SELECT layer, block_type, group_id, dense_rank() OVER (ORDER BY first) - 1 AS slot, layer = first AS updates FROM f
""")
def layer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.layer_groups(layers(spark), 2)


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as devices, with their nations' number as memory; one is unknown."""
    own = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("ordinal")).agg(F.sum("n_nationkey").alias("memory"))
    return own.select(F.concat(F.lit("cuda:"), F.col("ordinal").cast("string")).alias("device"), "ordinal", F.when(F.col("ordinal") != 2, F.col("memory")).alias("memory"))


PLACED = f"""
{LAYERS}, d AS (SELECT 'cuda:' || n_regionkey AS device, n_regionkey AS ordinal, CAST(CASE WHEN n_regionkey <> 2 THEN sum(n_nationkey) ELSE 1 END AS DOUBLE) AS w FROM nation GROUP BY n_regionkey),
c AS (SELECT *, sum(w) OVER (ORDER BY ordinal) AS s, sum(w) OVER () AS total, max(ordinal) OVER () AS last FROM d),
p AS (SELECT layer, block_type, arg_min(device, ordinal) AS device FROM l JOIN c ON (layer + 0.5) / 24 * total <= s OR ordinal = last GROUP BY layer, block_type)
"""


@query(f"WITH {PLACED} SELECT layer, device FROM p")
def layer_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.placed(layers(spark), devices(spark, sf_dir)).select("layer", "device")


@query(f"""
WITH {PLACED}, n AS (SELECT layer, device, CASE WHEN lag(device) OVER (ORDER BY layer) IS NOT DISTINCT FROM device THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT *, sum(new) OVER (ORDER BY layer) AS run FROM n)
SELECT 'layers ' || min(layer) || '-' || max(layer) || ' -> ' || device AS line FROM r GROUP BY run, device
""")
def device_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = planning.ranges(planning.placed(layers(spark), devices(spark, sf_dir)), "layer", "device")
    return own.select(F.format_string("layers %d-%d -> %s", "first", "last", "device").alias("line"))


@query("""
WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer), b AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS value FROM supplier)
SELECT a.key, a.value AS current, CASE WHEN b.key IS NULL THEN '<missing>' ELSE b.value END AS saved FROM a LEFT JOIN b USING (key) WHERE b.key IS NULL OR a.value IS DISTINCT FROM b.value
""")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    return planning.differences(now, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value")), "key", "value")


@query("""
WITH p AS (SELECT p_partkey, 'layers.' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.bias' ELSE '.weight' END AS name,
    (['Linear', 'Embedding', 'RMSNorm', 'GroupNorm', 'Conv'])[p_partkey % 5 + 1] AS cls, p_partkey % 4 AS dims, p_partkey % 7 <> 0 AS trainable, CAST(p_size AS BIGINT) * 1000003 AS numel FROM part),
g AS (SELECT *, CASE WHEN NOT trainable THEN 'frozen' WHEN name LIKE '%bias' OR cls IN ('Embedding', 'RMSNorm', 'GroupNorm') THEN 'no_decay' WHEN cls = 'Linear' OR dims >= 2 THEN 'decay' ELSE 'no_decay' END AS "group" FROM p)
SELECT "group", count(*) AS parameters, CAST(sum(numel) AS BIGINT) AS numel,
    CASE WHEN sum(numel) >= 1e9 THEN printf('%.2fB', sum(numel) / 1e9) WHEN sum(numel) >= 1e6 THEN printf('%.2fM', sum(numel) / 1e6) ELSE printf('%.2fK', sum(numel) / 1e3) END AS shown
FROM g GROUP BY "group"
""")
def parameter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(
        F.concat(F.lit("layers."), k.cast("string"), F.when(k % 3 == 0, ".bias").otherwise(".weight")).alias("name"),
        F.element_at(F.array(*map(F.lit, ["Linear", "Embedding", "RMSNorm", "GroupNorm", "Conv"])), (k % 5 + 1).cast("int")).alias("module_class"), (k % 4).alias("dims"), (k % 7 != 0).alias("trainable"), (F.col("p_size").cast("long") * 1000003).alias("numel"),
    )
    out = metrics.decay_groups(own).groupBy("group").agg(F.count(F.lit(1)).alias("parameters"), F.sum("numel").alias("numel"))
    return out.withColumn("shown", t.human_count("numel"))


@query("""
WITH p AS (SELECT i AS pos, d AS dim FROM range(0, 256) r(i), range(0, 8) s(d))
SELECT pos, dim, round(cos(pos / ((1 + dim / 4) * pow(10000, 2 * dim / 16))) * sqrt(1 + ln(4) / ln(4096)), 6) AS cos, round(sin(pos / ((1 + dim / 4) * pow(10000, 2 * dim / 16))) * sqrt(1 + ln(4) / ln(4096)), 6) AS sin FROM p
""")
def rotary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(256).select(F.col("id").alias("pos"), F.explode(planning.rotary(F.col("id"), [1 + d / 4 for d in range(8)], 16, scale=4.0, original=4096)).alias("r"))
    return own.select("pos", F.col("r.dim").cast("long").alias("dim"), rounded("r.cos", "cos"), rounded("r.sin", "sin"))


#: Generated ids of a document: remainders of its words' lengths, 1 an end and 0 padding.
@query("""
WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x) % 12) AS ids FROM documents),
c AS (SELECT doc_id, CASE WHEN list_contains(ids, 1) THEN ids[1:list_position(ids, 1) - 1] ELSE ids END AS ids FROM w),
t AS (SELECT doc_id, ids[1:coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 0)), 0)] AS ids FROM c)
SELECT doc_id, len(ids) AS tokens, md5(array_to_string(ids, ',')) AS ids_md5 FROM t
""")
def trim_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("doc_id", F.transform(F.split("text", " ", -1), lambda x: F.char_length(x) % 12).alias("ids"))
    own = own.withColumn("ids", ids.trimmed(F.col("ids"), 1, 0))
    return own.select("doc_id", F.size("ids").cast("long").alias("tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query(f"""
WITH c AS (SELECT conv_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY conv_id), b AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch_no FROM c),
p AS (SELECT conv_id, n, max(n) OVER (PARTITION BY batch_no) AS longest FROM b)
SELECT conv_id, array_to_string(list_concat(list_transform(range(0, longest - n), lambda x: 0), range(0, n)), ',') AS positions FROM p
""")
def left_padded_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from tessera.operators.encode import batched

    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    own = batched(own, 8, "conv_id", [F.col("conv_id")]).withColumn("longest", F.max("n").over(Window.partitionBy("batch_no")))
    mask = ids.left_padded(F.array_repeat(F.lit(1), F.col("n")), F.col("longest"), 0)
    return own.select("conv_id", F.array_join(ids.positions(mask).cast("array<string>"), ",").alias("positions"))


@query(f"""
WITH {sql.MESSAGES}
SELECT turn % 2 AS odd, role, count(*) AS messages, CAST(sum({sql.chars('content')}) AS BIGINT) AS tokens, CAST(max({sql.chars(sql.LABEL)}) AS BIGINT) AS label_tokens FROM g GROUP BY ALL
""")
def role_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .corpus import good_chats

    label = chat.TEMPLATES[chat.DEFAULT].label(F.col("m.role"))
    own = good_chats(spark, sf_dir).select("conv_id", F.explode("messages").alias("m")).withColumn("label", F.char_length(label))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.strip("text").alias("content"))
    kept = turns.join(own.select("conv_id").distinct(), "conv_id", "left_semi")
    labels = own.select(F.col("m.role").alias("role"), "label").distinct()
    return kept.join(F.broadcast(labels), "role").groupBy((F.col("turn") % 2).alias("odd"), "role").agg(F.count(F.lit(1)).alias("messages"), F.sum(t.char_count("content")).alias("tokens"), F.max("label").cast("long").alias("label_tokens"))


@query("""
WITH c AS (SELECT 'v' || vec_id AS name, list_transform(embedding, lambda x: round(1 + abs(x::DOUBLE), 4)) AS f, 'explicit' AS source, 0 AS part FROM embeddings
    UNION ALL SELECT 'u' || r_regionkey, list_transform(range(0, 32), lambda i: 2.0 + r_regionkey), 'uniform', 1 FROM region)
SELECT name, source, part, len(f) AS factors, list_min(f) AS least, list_max(f) AS most FROM c
""")
def factor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("name"), F.transform("embedding", lambda x: F.round(1 + F.abs(x.cast("double")), 4)).alias("long_factors"), F.lit("explicit").alias("source"))
    key = F.col("r_regionkey")
    uniform = table(spark, sf_dir, "region").select(F.concat(F.lit("u"), key.cast("string")).alias("name"), F.array_repeat(2.0 + key, 32).alias("long_factors"), F.lit("uniform").alias("source"))
    return configs.candidates(given, uniform).select("name", "source", "part", F.size("long_factors").cast("long").alias("factors"), F.array_min("long_factors").alias("least"), F.array_max("long_factors").alias("most"))


@query(f"""
WITH n AS (SELECT max({sql.chars(sql.strip('text'))} + 1) AS longest FROM documents WHERE {sql.strip('text')} <> ''),
c AS (SELECT n_nationkey AS id, CAST(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey * 4000 END AS INT) AS reach, n_nationkey % 2 = 0 AS known FROM nation)
SELECT id, known AND (reach IS NULL OR reach >= longest) AS reuse,
    round(CASE WHEN known AND (reach IS NULL OR reach >= longest) THEN 3.0 ELSE greatest(greatest(longest, 16384) / 4096, 1.0) END, 6) AS factor,
    CAST(CASE WHEN known AND reach >= longest THEN reach ELSE longest END AS BIGINT) AS factor_length
FROM c, n
""")
def factors_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .corpus import length_scan

    key = F.col("n_nationkey")
    own = table(spark, sf_dir, "nation").select(
        key.alias("id"), F.when(key % 3 != 0, key * 4000).cast("int").alias("longrope2_factor_max_sequence_length"), F.when(key % 2 == 0, F.array_repeat(F.lit(3.0), 32)).alias("longrope2_long_factors"),
        F.lit(16384).alias("longrope2_target_length"), F.lit(4096).alias("original_max_len"), F.lit(64).alias("head_dim"),
    )
    out = configs.factors_due(own, length_scan(spark, sf_dir))
    return out.select("id", "reuse", rounded(F.col("factors")[0], "factor"), F.col("factor_length").cast("long").alias("factor_length"))


@query("""
WITH v AS (SELECT c_custkey, (['0,1', ' 2 , 3,,', '-1', '', 'none', NULL])[c_custkey % 6 + 1] AS v FROM customer)
SELECT c_custkey, CASE WHEN v IS NULL THEN NULL WHEN trim(v) IN ('', '-1', 'none', 'None') THEN '' ELSE array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS devices FROM v
""")
def visible_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*map(F.lit, ["0,1", " 2 , 3,,", "-1", "", "none", None]))
    own = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(values, (F.col("c_custkey") % 6 + 1).cast("int")).alias("v"))
    return own.select("c_custkey", F.array_join(configs.visible_devices(F.col("v")), "|").alias("devices"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL
""")
def revenue_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain relational coverage: a grouped aggregate."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name
""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain relational coverage: joins of four tables."""
    own = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return own.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


#: Sequences of embeddings: 8 positions of 8 logits, with labels by a rule; of some sequences no label counts.
LOSS_SQL = """
WITH r AS (
    SELECT vec_id, list_transform(range(8), lambda t: embedding[t * 8 + 1 : t * 8 + 8]) AS logits,
        list_transform(range(8), lambda t: CASE WHEN vec_id % 13 = 0 OR (vec_id * 7 + t * 3) % 9 = 8 THEN -100 ELSE (vec_id * 7 + t * 3) % 9 END) AS labels FROM embeddings
), p AS (SELECT vec_id, t, logits[t] AS x, labels[t + 1] AS y FROM r, range(1, 8) s(t)),
l AS (SELECT vec_id, CASE WHEN y <> -100 THEN ln(list_sum(list_transform(x, lambda v: exp(v::DOUBLE)))) - x[y + 1]::DOUBLE END AS loss FROM p)
SELECT vec_id, count(loss) AS tokens, round(coalesce(sum(loss), 0), 6) AS loss_sum, round(avg(loss), 6) AS mean_loss, count(loss) = 0 AS no_mean FROM l GROUP BY vec_id
"""


@query(LOSS_SQL)
def lm_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda p: (F.col("vec_id") * 7 + p * 3) % 9
    places = F.sequence(F.lit(0), F.lit(7))
    label = lambda p: F.when((F.col("vec_id") % 13 == 0) | (rule(p) == 8), IGNORED).otherwise(rule(p)).cast("int")
    own = table(spark, sf_dir, "embeddings").select("vec_id", metrics.language_model_loss(F.transform(places, lambda p: F.slice("embedding", p * 8 + 1, 8)), F.transform(places, label)).alias("x"))
    mean = F.when(~F.isnan("x.mean_loss"), F.col("x.mean_loss"))
    return own.select("vec_id", F.col("x.tokens").cast("long").alias("tokens"), F.round("x.loss_sum", 6).alias("loss_sum"), F.round(mean, 6).alias("mean_loss"), F.isnan("x.mean_loss").alias("no_mean"))


@query("""
WITH c(task_name, case_no, depth) AS (VALUES ('needle_in_a_haystack', 0, 0.2), ('needle_in_a_haystack', 1, 0.5), ('needle_in_a_haystack', 2, 0.8), ('needle_in_a_haystack', 3, 0.2), ('needle_in_a_haystack', 4, 0.5), ('needle_in_a_haystack', 5, 0.8), ('qa_retrieval', 0, NULL), ('qa_retrieval', 1, NULL)),
s AS (SELECT *, case_no % 4 = 3 OR (task_name = 'qa_retrieval' AND case_no = 1) AS failed, case_no % 4 < 2 AS hit, (case_no + 1) / 10.0 AS latency FROM c)
SELECT task_name, count(*) AS samples, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, round(count(*) FILTER (NOT failed AND hit) / count(*), 6) AS exact_match_rate, round(avg(CASE WHEN NOT failed THEN latency END), 6) AS avg_latency FROM s GROUP BY task_name
""")
def long_context_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite's rates: predictions are the answer, a sentence with it, another word, an error, in turn; one case has none."""
    cases = longctx.suite_cases(spark, [2048, 4096], [0.2, 0.5, 0.8], [2048, 4096])
    turn = F.col("case_no") % 4
    said = F.when(turn == 0, F.col("expected_answer")).when(turn == 1, F.concat(F.lit("答案是 "), "expected_answer", F.lit("。"))).otherwise("unknown")
    own = cases.where(~((F.col("task_name") == longctx.RETRIEVAL_TASK) & (F.col("case_no") == 1)))
    predictions = own.select("task_name", "case_no", said.alias("prediction"), ((F.col("case_no") + 1) / 10).alias("latency"), F.when(turn == 3, "stopped").alias("error"))
    out = metrics.generation_rates(longctx.suite_samples(cases, predictions), ["task_name"])
    return out.select("task_name", "samples", "succeeded", "failed", rounded("exact_match_rate", "exact_match_rate"), rounded("avg_latency", "avg_latency"))


@query("""
WITH p AS (SELECT i AS pos, d AS dim, 1 + (1 + d / 4 - 1) * (6144 / 4096 - 1) / (16384 / 4096 - 1) AS dynamic FROM range(0, 128) r(i), range(0, 8) s(d)),
a AS (SELECT pos, dim, dynamic, pos / ((1 + dim / 4) * pow(10000, 2 * dim / 16)) AS scaled, pos / pow(10000, 2 * dim / 16) AS plain FROM p)
SELECT pos, dim, round(dynamic, 6) AS dynamic, round(CASE WHEN pos < 16 THEN cos(plain) ELSE cos(scaled) * sqrt(1 + ln(4) / ln(4096)) END, 6) AS cos, round(CASE WHEN pos < 16 THEN sin(plain) ELSE sin(scaled) * sqrt(1 + ln(4) / ln(4096)) END, 6) AS sin FROM a
""")
def rotary_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of a length between the original and the longest, and tables that keep the first positions unscaled."""
    factors = [1 + d / 4 for d in range(8)]
    dynamic = planning.dynamic_factors(F.array(*map(F.lit, factors)), F.lit(6144.0), 4096, 16384)
    own = spark.range(128).select(F.col("id").alias("pos"), dynamic.alias("f"), F.explode(planning.rotary_mixed(F.col("id"), factors, 16, 16, scale=4.0, original=4096)).alias("r"))
    return own.select("pos", F.col("r.dim").cast("long").alias("dim"), rounded(F.get("f", F.col("r.dim")), "dynamic"), rounded("r.cos", "cos"), rounded("r.sin", "sin"))


@query("""
SELECT h AS head, i AS distance, round(CASE WHEN i >= 0 THEN pow(1 - pow(2, -5 - h * 4 / 7), i) ELSE 0 END, 6) AS kept, round(pow((2 * h + 6.4) / 22.4, abs(i) / 512), 6) AS up, round(pow((2 * h + 6.4) / 22.4, -abs(i) / 512), 6) AS down FROM range(0, 8) r(h), range(-8, 64) s(i)
""")
def decay_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay by head and distance, and scales of pairs of 16 dimensions by position."""
    own = spark.range(8).select(F.col("id").alias("head"), F.explode(F.sequence(F.lit(-8).cast("long"), F.lit(63).cast("long"))).alias("distance"))
    scale = lambda down, name: rounded(planning.position_scale(F.abs("distance"), F.col("head"), 16, down=down), name)
    return own.select("head", "distance", rounded(planning.relative_decay(F.col("head"), 8, F.col("distance")), "kept"), scale(False, "up"), scale(True, "down"))


@query(f"""
WITH {BATCHES}, s AS (SELECT epoch, CAST(ceil(batch / 10) AS BIGINT) AS log_no, max(batch) AS last_step, sum(samples * 0.25) AS seconds, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(samples) AS BIGINT) AS samples FROM e GROUP BY ALL)
SELECT epoch, log_no, last_step, CAST(seconds AS DOUBLE) AS seconds, tokens, samples, round(tokens / seconds, 6) AS tokens_per_sec, round(samples / seconds, 6) AS samples_per_sec FROM s
""")
def log_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput between logs, a step taking a quarter of a second for each sample."""
    out = metrics.log_rates(batches(spark, sf_dir), "epoch", "batch", options.Training().log_interval, F.col("samples") * 0.25, ["tokens", "samples"])
    return out.select("epoch", "log_no", "last_step", "seconds", "tokens", "samples", rounded("tokens_per_sec", "tokens_per_sec"), rounded("samples_per_sec", "samples_per_sec"))


@query("""
WITH c AS (SELECT n_regionkey AS id, count(*) AS n, list('gpu' || n_nationkey % 3 ORDER BY n_nationkey) AS d FROM nation GROUP BY ALL),
p AS (SELECT id, 'list' AS shape, unnest(range(CAST(n AS BIGINT))) AS i, d FROM c UNION ALL SELECT id, 'layers', unnest(range(CAST(n AS BIGINT))), d FROM c UNION ALL SELECT id, 'numbers', unnest(range(CAST(n AS BIGINT))), d FROM c)
SELECT id, shape, CAST(i AS VARCHAR) AS part, d[i + 1] AS device, NULL AS error FROM p
UNION ALL SELECT id, 'layers', 'embedding', d[1], NULL FROM c UNION ALL SELECT id, 'numbers', 'norm', d[2], NULL FROM c
UNION ALL SELECT id, 'short', NULL, NULL, n - 1 || ' devices for ' || n || ' layers' FROM c UNION ALL SELECT id, 'none', NULL, NULL, 'no layers' FROM c
""")
def device_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of each region's nations as layers, in five shapes, two of which don't fit."""
    own = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("gpu"), (F.col("n_nationkey") % 3).cast("string")).alias("d")))).alias("x"))
    d = F.transform("x", lambda y: y["d"])
    by_number = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(d) - 1), lambda i: i.cast("string")), d)
    shapes = {
        "list": F.to_json(d), "layers": F.to_json(F.struct(d.alias("layers"), d[0].alias("embedding"))), "numbers": F.to_json(F.struct(by_number.alias("layers"), F.struct(d[1].alias("norm")).alias("modules"))),
        "short": F.to_json(F.slice(d, 1, F.size(d) - 1)), "none": F.lit('{"modules": {}}'),
    }
    rows = own.select("id", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), v.alias("spec")) for k, v in shapes.items()])).alias("s"))
    specs = rows.select(F.struct("id", "s.shape").alias("key"), "n", F.parse_json("s.spec").alias("v"))
    return planning.device_maps(specs, "key", "v", "n").select("key.id", "key.shape", "part", "device", "error")
