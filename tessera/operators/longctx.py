"""Made-up cases for long contexts, and scoring of answers. Numbers in them come from md5, so that they are the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import char_count, short_answer

from .chat import prompt

# Parts of the cases' texts.
TOPICS = ["古籍整理", "植物观察", "课堂讨论", "档案编目", "城市地理", "数学笔记", "物理实验", "历史摘录"]
VERBS = ["记录", "整理", "分析", "讨论", "归纳", "标注", "复核", "补充"]
CITIES = ["上海", "北京", "广州", "深圳", "成都", "武汉"]
COLORS = ["红", "蓝", "绿", "黄", "紫", "灰"]
FILLER = "段落%04d：研究人员围绕%s%s样本，补充了编号为%d的说明，并强调需要保持上下文顺序稳定。"
NEEDLE = "隐藏针：本段资料唯一需要记住的代号是 %s。"
NEEDLE_QUESTION = "问题：隐藏针中的代号是什么？请只输出代号。"
NEEDLE_INTRO = "下面是一段很长的资料，请先通读，再回答最后的问题。\n\n"
RECORD = "档案 A%03d：城市=%s；颜色=%s；密钥=KEY-%04d-%03d。"
RECORD_QUESTION = "问题：档案 A%03d 的密钥是什么？请只输出密钥。"
RECORD_INTRO = "下面是一个很长的档案目录，请根据目录回答最后的问题。\n\n"


def chosen(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def number(low: int, high: int, *parts: Column) -> Column:
    """A whole number from low to high, by a hash of the parts."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
    return low + h % (high - low + 1)


def grid(spark: SparkSession, lengths: list[int], depths: list[float], seed: int) -> DataFrame:
    """case_no, target, depth, seed: all lengths by all depths; seeds go up by one."""
    rows = [(i, n, d, seed + i) for i, (n, d) in enumerate((n, d) for n in lengths for d in depths)]
    return spark.createDataFrame(rows, "case_no long, target int, depth double, seed int")


def user_prompt(content: Column) -> Column:
    return prompt(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))), ask=True)


def needle_cases(cases: DataFrame) -> DataFrame:
    """Adds expected_answer and prompt_text: paragraphs until needle, question and they have ``target`` characters, the needle at ``depth``."""
    answer = F.format_string("NIAH-%04d-%02d", "seed", (F.col("depth") * 100).cast("int"))
    own = cases.withColumn("expected_answer", answer).withColumn("needle", F.format_string(NEEDLE, "expected_answer"))
    fixed = char_count(F.concat("needle", F.lit("\n" + NEEDLE_QUESTION + "\n")))
    i = F.col("i")
    text = F.format_string(FILLER, i, chosen(TOPICS, i), chosen(VERBS, i * 3), number(100, 999, F.col("seed"), i))
    rows = own.withColumn("fixed", fixed).withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("target") / 40).cast("int"))))).withColumn("text", text)
    before = Window.partitionBy("case_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("size", F.col("fixed") + F.coalesce(F.sum(char_count("text") + 1).over(before) - 1, F.lit(0)))
    kept = rows.where("size < target").groupBy("case_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]).alias("parts"))
    own = own.join(kept, "case_no", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    n = F.size("parts")
    at = F.least(n, F.greatest(F.lit(0), (n * F.col("depth")).cast("int")))
    parts = F.concat(F.slice("parts", 1, at), F.array("needle"), F.slice("parts", at + 1, F.greatest(n - at, F.lit(0))))
    content = F.concat(F.lit(NEEDLE_INTRO), F.array_join(parts, "\n"), F.lit("\n\n" + NEEDLE_QUESTION))
    return own.select("case_no", "target", "depth", "seed", "expected_answer", user_prompt(content).alias("prompt_text"))


def retrieval_cases(cases: DataFrame) -> DataFrame:
    """Adds expected_answer and prompt_text: records until the prompt has ``target`` characters, the asked one in it or not."""
    own = cases.withColumn("asked", number(8, 32, F.lit("retrieval"), F.col("seed")).cast("int"))
    question, i = F.format_string(RECORD_QUESTION, "asked"), F.col("i")
    own = own.withColumn("question", question).withColumn("fixed", char_count(user_prompt(F.concat(F.lit(RECORD_INTRO), F.lit("\n\n"), "question"))))
    text = F.format_string(RECORD, i, chosen(CITIES, i), chosen(COLORS, i), F.col("seed"), i)
    rows = own.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("target") / 30).cast("int"))))).withColumn("text", text)
    before = Window.partitionBy("case_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("size", F.col("fixed") + F.coalesce(F.sum(char_count("text") + 1).over(before) - 1, F.lit(0)))
    kept = rows.where("size < target OR i = 1").groupBy("case_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"]), "\n").alias("parts"))
    own = own.join(kept, "case_no")
    content = F.concat(F.lit(RECORD_INTRO), "parts", F.lit("\n\n"), "question")
    return own.select("case_no", "target", "seed", F.format_string("KEY-%04d-%03d", "seed", "asked").alias("expected_answer"), user_prompt(content).alias("prompt_text"))


def matched(predicted: Column | str, expected: Column | str) -> Column:
    """The answer, both cleaned, is or holds what is expected."""
    return F.contains(short_answer(predicted), short_answer(expected))


#: Names of tasks; what a suite's seed is raised by for retrieval.
NEEDLE_TASK, RETRIEVAL_TASK, RETRIEVAL_SEED = "needle_in_a_haystack", "qa_retrieval", 1000


def suite_cases(spark: SparkSession, lengths: list[int], depths: list[float], retrieval_lengths: list[int], seed: int = 42) -> DataFrame:
    """All cases of a suite: task_name, case_no, target, depth (null for retrieval), seed, expected_answer, prompt_text."""
    needle = needle_cases(grid(spark, lengths, depths, seed)).withColumn("task_name", F.lit(NEEDLE_TASK))
    retrieval = retrieval_cases(grid(spark, retrieval_lengths, [0.0], seed + RETRIEVAL_SEED)).withColumns({"task_name": F.lit(RETRIEVAL_TASK), "depth": F.lit(None).cast("double")})
    names = ["task_name", "case_no", "target", "depth", "seed", "expected_answer", "prompt_text"]
    return needle.select(names).unionByName(retrieval.select(names))


def suite_samples(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cases with what a model said of them (task_name, case_no, prediction, latency, error): status and matched. A case without a
    prediction, or with an error, has failed, and the others count all the same."""
    own = cases.join(predictions, ["task_name", "case_no"], "left")
    ok = F.col("error").isNull() & F.col("prediction").isNotNull()
    return own.withColumns({"status": F.when(ok, "ok").otherwise("failed"), "matched": F.coalesce(ok & matched("prediction", "expected_answer"), F.lit(False))})


def sweep_results(rates: DataFrame, perplexities: DataFrame) -> DataFrame:
    """Of candidates' rates (name, task_name, samples, succeeded, exact_match_rate) and perplexities (name, window_size, perplexity) what a
    sweep's report shows: name, status (failed if no sample succeeded), needle, retrieval, ppl. One that fails doesn't stop the others."""
    rate = lambda task: F.max(F.when(F.col("task_name") == task, F.col("exact_match_rate")))
    own = rates.groupBy("name").agg(F.when(F.sum("succeeded") > 0, "ok").otherwise("failed").alias("status"), rate(NEEDLE_TASK).alias("needle"), rate(RETRIEVAL_TASK).alias("retrieval"))
    ppl = perplexities.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("window_size", "perplexity"))).alias("ppl"))
    return own.join(ppl, "name", "left").withColumn("ppl", F.coalesce("ppl", F.array().cast("array<struct<window_size:int,perplexity:double>>")))
