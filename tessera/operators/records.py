"""Structured records: checks and clean-up that emit a reason instead of failing, so that strict and lenient use share a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import optional, strip

#: Roles of messages.
ROLES = ["system", "user", "assistant", "observation"]
#: Fixed value: the source of records without one, in summaries.
UNKNOWN = "<unknown>"


def normalize_text(df: DataFrame, text: str = "text", record_id: Column | None = None) -> DataFrame:
    """Adds id, type, clean text and optional fields, and error_code (null if the record is fine)."""
    out = df.withColumn("text", strip(text)).withColumn("type", F.lit("text")).withColumn("id", strip(record_id.cast("string")) if record_id is not None else F.col("id"))
    for c in ("source", "language", "split"):
        if c in df.columns:
            out = out.withColumn(c, optional(c))
    code = F.when(F.col("text").isNull(), "text_missing").when(F.col("text") == "", "text_blank").when(F.col("id").isNull() | (F.col("id") == ""), "id_missing")
    return out.withColumn("error_code", code)


def dispatched(df: DataFrame, default_id: Column | None = None) -> DataFrame:
    """Records of mixed types (type, id, text, messages, and the optional fields) as they are stored, each by the rules of its type:
    what the type doesn't have is null, and error_code is null if the record is fine."""
    kind = strip("type")
    own = F.nullif(strip("id"), F.lit(""))
    out = df.withColumns({"text": strip("text"), "messages": normalize_messages(F.col("messages")), "id": F.coalesce(own, strip(default_id.cast("string"))) if default_id is not None else own, "type": kind})
    out = out.withColumns({c: optional(c) for c in ("source", "language", "split") if c in df.columns})
    is_text, is_chat = F.col("type") == "text", F.col("type") == "chat"
    text_error = F.when(F.col("text").isNull(), "text_missing").when(F.col("text") == "", "text_blank")
    code = (
        F.when(F.col("type").isNull() | ~(is_text | is_chat), "type_unknown").when(F.col("id").isNull() | (F.col("id") == ""), "id_missing")
        .when(is_text, text_error).otherwise(messages_error(F.col("messages")))
    )
    return out.withColumns({"error_code": code, "text": F.when(is_text, F.col("text")), "messages": F.when(is_chat, F.col("messages"))})


def with_defaults(df: DataFrame, **defaults: str) -> DataFrame:
    """Fields that are missing, null or blank get their default."""
    return df.withColumns({c: F.coalesce(optional(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def made_id(source: Column | str, number: Column, chunk: Column | None = None, chunks: Column | None = None) -> Column:
    """Source and a number of six digits or more; a record that was cut into more than one chunk adds the chunk's (from 1), of four."""
    out = F.format_string("%s-%06d", F.col(source) if isinstance(source, str) else source, number)
    return out if chunk is None else F.when(chunks > 1, F.concat(out, F.format_string("-%04d", chunk))).otherwise(out)


#: Fields that are counted where there is neither text nor messages, in this order.
COUNTED = ["instruction", "context", "input", "output", "response", "content"]


#: String literals of JSON, and what is between them.
JSON_PARTS = r'"(?:[^"\\]|\\.)*+"|[^"]++'


def sorted_json(v: Column) -> Column:
    """A variant as JSON with sorted keys at every depth, and a space after commas and colons. Variants keep their keys sorted; what lies
    between string literals gets the spaces."""
    parts = F.regexp_extract_all(F.to_json(v), F.lit(JSON_PARTS), 0)
    spaced = F.transform(parts, lambda x: F.when(F.startswith(x, F.lit('"')), x).otherwise(F.replace(F.replace(x, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))))
    return F.array_join(spaced, "")


def counting_text(v: Column) -> Column:
    """What a record's tokens are counted of: a string itself; an object's text; its messages as lines of role and content, without blank ones; what isn't blank of
    the usual fields, as lines; and else the record as sorted JSON. v: a variant; null gives null."""

    def text(x: Column, name: str) -> Column:
        own = F.try_variant_get(x, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(x, f"$.{name}", "string"))

    def shown(x: Column, name: str) -> Column:
        return strip(F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit("")))

    def line(m: Column) -> Column:
        role, content = shown(m, "role"), shown(m, "content")
        return F.when(content == "", F.lit("")).when(role == "", content).otherwise(F.concat(role, F.lit(": "), content))

    joined = lambda xs: F.nullif(F.array_join(F.filter(xs, lambda x: x.isNotNull() & (x != "")), "\n"), F.lit(""))
    messages = joined(F.transform(F.try_variant_get(v, "$.messages", "array<variant>"), line))
    usual = joined(F.array(*[strip(text(v, c)) for c in COUNTED]))
    alone = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(alone, text(v, "text"), messages, usual, sorted_json(v))


def normalize_messages(messages: Column) -> Column:
    """Messages with role and stripped content only."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content")))


def messages_error(messages: Column) -> Column:
    """Why messages (normalized) aren't fine; null if they are."""
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "messages_empty")
        .when(F.exists(messages, lambda m: m["role"].isNull() | ~m["role"].isin(ROLES)), "role_unknown")
        .when(F.exists(messages, lambda m: m["content"].isNull() | (m["content"] == "")), "content_blank")
    )


def strict(df: DataFrame) -> DataFrame:
    """Fails on the first record with an error, as loaders do."""
    fine = F.when(F.col("error_code").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad record: "), F.col("error_code"))).cast("boolean"))
    return df.where(fine)


def lenient(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and bad records, as converters do."""
    return df.where("error_code IS NULL"), df.where("error_code IS NOT NULL")


def require_types(df: DataFrame, types: list[str]) -> DataFrame:
    """Fails on records of other types."""
    said = F.concat(F.lit(f"expected types {sorted(types)}, found "), F.coalesce("type", F.lit("none")))
    return df.where(F.when(F.col("type").isin(types), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def chat_records(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record a conversation: id, messages in the order of turns (at most one a turn counts on), error_code."""
    own = df.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("messages"))
    own = own.withColumn("messages", normalize_messages(F.col("messages")))
    return own.withColumn("error_code", messages_error(F.col("messages")))


def summary(df: DataFrame) -> DataFrame:
    """Counts by type and by source, in one pass: kind, name, records."""
    own = df.select("type", F.coalesce("source", F.lit(UNKNOWN)).alias("source"))
    sets = own.groupingSets([["type"], ["source"]], "type", "source").agg(F.count(F.lit(1)).alias("records"), F.grouping("type").alias("by_source"))
    return sets.select(F.when(F.col("by_source") == 1, "source").otherwise("type").alias("kind"), F.coalesce("type", "source").alias("name"), "records")
