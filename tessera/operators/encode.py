"""From token counts to batches: packing, padding, windows for perplexity, and chunks of lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.ids import IGNORED, padded_size, right_padded
from tessera.functions.tokenizers import Units, loaded, units

from .ordering import ordinal, running


def length_scan(df: DataFrame, tokens: str, order: str, record_id: str, strict: bool = False) -> DataFrame:
    """Number of samples, the longest, and the first record that long. One row; of no records, with ``strict``, an error."""
    some = F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1))).otherwise(F.raise_error(F.lit("no records to scan")).cast("long") if strict else 0)
    return df.agg(some.alias("samples"), F.max(tokens).alias("max_tokens"), F.max_by(record_id, F.struct(F.col(tokens), -F.col(order))).alias("longest_id"))


def batched(df: DataFrame, size: int, block: Column, order: list[Column]) -> DataFrame:
    """Adds batch_no and batch_pos: consecutive rows, the last batch may be smaller."""
    out = ordinal(df, block, order)
    return out.withColumn("batch_no", F.floor(F.col("ordinal") / size)).withColumn("batch_pos", F.col("ordinal") % size).drop("ordinal")


def first_batches(df: DataFrame, most: int | None) -> DataFrame:
    """Rows of the first ``most`` batches; all without a limit."""
    return df if most is None else df.where(F.col("batch_no") < most)


def packed(df: DataFrame, tokens: str, most: int, carried: list[str] | None = None) -> DataFrame:
    """Next-fit packing within each batch: batch_no, batch_pos, bin_no, bin_pos, position (first token's place in the bin), and the columns ``carried``.

    A bin closes when the next sample doesn't fit; samples are never cut, and one longer than ``most`` fails. Batches are small
    (a parameter of the loader), so that a fold over a batch is bounded.
    """
    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carried or [])]
    own = df.groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("batch_pos", F.struct(F.col(tokens).cast("int").alias("n"), *kept).alias("x")))).alias("samples"))
    start = F.expr("CAST(struct(0 AS bin_no, 0 AS used, 0 AS bin_pos, array() AS placed) AS struct<bin_no:int,used:int,bin_pos:int,placed:array<struct<n:int,bin_no:int,bin_pos:int,position:int>>>)")

    def step(a: Column, n: Column) -> Column:
        fits = (a["used"] + n <= most) | (a["used"] == 0)
        n = F.when(n <= most, n).otherwise(F.raise_error(F.lit(f"a sample has more than {most} tokens")).cast("int"))
        bin_no, at, pos = F.when(fits, a["bin_no"]).otherwise(a["bin_no"] + 1), F.when(fits, a["used"]).otherwise(0), F.when(fits, a["bin_pos"]).otherwise(0)
        one = F.struct(n.alias("n"), bin_no.alias("bin_no"), pos.alias("bin_pos"), at.alias("position"))
        return F.struct(bin_no.alias("bin_no"), (at + n).alias("used"), (pos + 1).alias("bin_pos"), F.concat(a["placed"], F.array(one)).alias("placed"))

    placed = F.aggregate(F.transform("samples", lambda s: s["x"]["n"]), start, step)["placed"]
    out = own.select("batch_no", F.explode(F.arrays_zip(placed.alias("p"), F.col("samples").alias("s"))).alias("z")).select("batch_no", F.col("z")["p"].alias("p"), F.col("z")["s"].alias("s"))
    more = [F.col(f"s.x._c{i}").alias(c) for i, c in enumerate(carried or [])]
    return out.select("batch_no", "s.batch_pos", F.col("p.n").alias("tokens"), "p.bin_no", "p.bin_pos", "p.position", *more)


def packed_arrays(df: DataFrame, ids: str, labels: str, most: int) -> DataFrame:
    """A row for each bin of ``packed``: batch_no, bin_no, input_ids and labels of its samples one after another, position_ids that
    start again with each, and segment_ids that count them from 1. Ids go along with the fold, so that samples are made once."""
    bins = packed(df.withColumn("_n", F.size(ids)), "_n", most, [ids, labels])
    own = bins.groupBy("batch_no", "bin_no").agg(F.array_sort(F.collect_list(F.struct("bin_pos", F.col(ids).alias("ids"), F.col(labels).alias("labels")))).alias("s"))
    each = lambda f: F.flatten(F.transform("s", f))
    some = lambda x, full: F.when(F.size(x["ids"]) > 0, full).otherwise(F.array().cast("array<int>"))
    return own.select(
        "batch_no", "bin_no", each(lambda x: x["ids"]).alias("input_ids"), each(lambda x: x["labels"]).alias("labels"),
        each(lambda x: some(x, F.sequence(F.lit(0), F.size(x["ids"]) - 1))).alias("position_ids"), each(lambda x: F.array_repeat(x["bin_pos"] + 1, F.size(x["ids"]))).alias("segment_ids"),
    )


def padded_batches(df: DataFrame, pad_id: int, multiple: int = 1) -> DataFrame:
    """Rows of batches (batch_no, input_ids, labels, and more arrays as in ``packed_arrays``), each padded to the longest of its batch, or
    the next multiple: pad_id for ids, IGNORED for labels, 0 for the rest; attention_mask is 1 where a token is."""
    longest = padded_size(F.max(F.size("input_ids")).over(Window.partitionBy("batch_no")), multiple)
    own = df.withColumn("_size", longest).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    fill = {"input_ids": pad_id, "labels": IGNORED, "attention_mask": 0, "position_ids": 0, "segment_ids": 0}
    return own.withColumns({c: right_padded(F.col(c), F.col("_size"), v) for c, v in fill.items() if c in own.columns}).drop("_size")


def collated(df: DataFrame, pad_id: int, most: int, pack: bool = False, multiple: int = 1) -> DataFrame:
    """Batches (batch_no, batch_pos, input_ids, labels) as training takes them: padded sample by sample, or packed into bins first."""
    return padded_batches(packed_arrays(df, "input_ids", "labels", most) if pack else df, pad_id, multiple)


def windows(df: DataFrame, tokens: str, size: int, block: Column, order: list[Column], record_id: str, most: int | None = None) -> DataFrame:
    """Consecutive windows of ``size`` tokens over all records in order, an end after each that isn't empty: a row for each
    window and record in it, with the record's first token there and their number. The rest that fills no window is left out."""
    own = running(df.where(F.col(tokens) > 0), block, order, {"start": F.col(tokens) + 1})
    total = own.agg(F.floor(F.coalesce(F.max(F.col("start") + F.col(tokens) + 1), F.lit(0)) / size).alias("full"))
    parts = own.withColumn("window_no", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col(tokens)) / size))))
    out = parts.crossJoin(F.broadcast(total)).where("window_no < full").drop("full")
    out = out.where(F.col("window_no") < most) if most else out
    first = F.greatest(F.col("window_no") * size - F.col("start"), F.lit(0))
    last = F.least((F.col("window_no") + 1) * size - F.col("start"), F.col(tokens) + 1)
    return out.select("window_no", record_id, first.alias("first_token"), (last - first).alias("window_tokens"))


def id_windows(df: DataFrame, ids: Column | str, end_id: int, size: int, block: Column | str, order: list[Column], most: int | None = None, tokens: Column | None = None) -> DataFrame:
    """window_no and ids of consecutive windows of exactly ``size`` ids over all records in order, an end after each that has ids. A record gives each
    window only the ids that lie there, so that what is shuffled is each id once, and a long record isn't repeated. The rest that fills no window is left out.
    tokens: how many ids a record has, where that is known without making them: ``ids`` may then be an expression, and is made once, when records have their places."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    own = df.withColumn("_tokens", F.coalesce((F.size(ids) if tokens is None else tokens).cast("int"), F.lit(0))).where("_tokens > 0")
    own = running(own, block, order, {"_start": F.col("_tokens") + 1}).select("_start", F.concat(ids, F.array(F.lit(end_id))).alias("_ids"))
    first, last = F.floor(F.col("_start") / size), F.floor((F.col("_start") + F.size("_ids") - 1) / size)

    def part(w: Column) -> Column:
        begin = F.greatest(w * size - F.col("_start"), F.lit(0)).cast("int")
        return F.struct(w.alias("window_no"), F.greatest(F.col("_start") - w * size, F.lit(0)).alias("at"), F.slice("_ids", begin + 1, F.least((w + 1) * size - F.col("_start"), F.size("_ids")).cast("int") - begin).alias("ids"))

    parts = own.select(F.explode(F.transform(F.sequence(first, last), part)).alias("p")).select("p.*")
    parts = parts.where(F.col("window_no") < most) if most else parts
    whole = parts.groupBy("window_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.where(F.size("ids") == size)


def visible_blocks(df: DataFrame, bins: list[str], start: str, tokens: str, size: int) -> DataFrame:
    """What attention sees of packed segments, block by block: for each pair of query and key blocks of ``size`` tokens with something visible, the
    number of visible pairs of tokens, and whether all of them are (full), or only those within segments and not after the query (edge).
    Segments are intervals, so that a bin costs its block pairs and not its pairs of tokens. A bin's segments are one row, and its pairs are made from it
    one after another, so that a task holds segments and never pairs."""
    begin, end = F.col(start).cast("long"), (F.col(start) + F.col(tokens)).cast("long")
    own = df.where(F.col(tokens) > 0).groupBy(*bins).agg(F.collect_list(F.struct(begin.alias("a"), end.alias("b"))).alias("_s"))
    block = lambda x: F.floor(x / size)
    ends = F.sequence(block(F.array_min("_s.a")), block(F.array_max("_s.b") - 1))
    queries = own.select("*", F.explode(ends).alias("query_block"))
    queries = queries.withColumn("_s", F.filter("_s", lambda x: (x["a"] < (F.col("query_block") + 1) * size) & (x["b"] > F.col("query_block") * size))).where(F.size("_s") > 0)
    pairs = queries.select("*", F.explode(F.sequence(block(F.array_min("_s.a")), F.col("query_block"))).alias("key_block"))

    def seen(x: Column) -> Column:
        inside = lambda c: F.greatest(F.lit(0), F.least(x["b"], (F.col(c) + 1) * size) - F.greatest(x["a"], F.col(c) * size))
        q, k = inside("query_block"), inside("key_block")
        return F.when(F.col("query_block") == F.col("key_block"), (q * (q + 1) / 2).cast("long")).otherwise(q * k)

    visible = F.aggregate("_s", F.lit(0).cast("long"), lambda n, x: n + seen(x))
    sums = pairs.select(*bins, "query_block", "key_block", visible.alias("visible")).where("visible > 0")
    return sums.withColumn("kind", F.when(F.col("visible") == size * size, "full").otherwise("edge"))


def token_chunks_of(text: str | None, most: int, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str]) -> Iterator[str]:
    """Stripped lines that aren't blank, joined as long as ``most`` tokens hold them; a longer line is cut by its ids. Tokens of joined lines aren't the
    sum of the lines', so that the number of lines is searched for, by doubling steps and then by halving: this takes for granted that another line
    makes no text shorter in tokens."""
    own = [x for x in map(str.strip, (text or "").splitlines()) if x]
    at, guess = 0, 1
    while at < len(own):
        fits = lambda n: n == 1 or len(encode("\n".join(own[at : at + n]))) <= most  # noqa: B023, E731
        low, high, step = 1, len(own) - at + 1, max(1, guess // 2)
        while low + step < high:
            if not fits(low + step):
                high = low + step
                break
            low, step = low + step, 2 * step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        whole, at, guess = "\n".join(own[at : at + low]), at + low, low
        ids = encode(whole)
        yield from [whole] if len(ids) <= most else cut_by_ids(ids, most, decode)


def cut_by_ids(ids: list[int], most: int, decode: Callable[[list[int]], str]) -> Iterator[str]:
    return filter(None, (decode(ids[i : i + most]).strip() for i in range(0, len(ids), most)))


def summed_chunks_of(text: str | None, most: int, own: Units, decode: Callable[[list[int]], str]) -> Iterator[str]:
    """As ``token_chunks_of`` where joined lines have the lines' tokens and ``feed`` for each line feed, so that each line is read once."""
    lines = [x for x in map(str.strip, (text or "").splitlines()) if x]
    group, used = [], 0
    for line, n in zip((*lines, None), (*own.counts(lines), 0), strict=True):
        if group and (line is None or used + own.feed + n > most):
            yield from ["\n".join(group)] if used <= most else cut_by_ids(own.ids(group[0]), most, decode)
            group, used = [], 0
        if line is not None:
            used += n + own.feed * bool(group)
            group.append(line)


def chunks_of(text: str | None, most: int) -> Iterator[str]:
    """Stripped lines that aren't blank, joined as long as ``most`` characters hold them; a longer line is cut every ``most``."""
    group, used = [], 0
    for line in (*(text or "").splitlines(), None):
        line = line.strip() if line is not None else None
        if line == "":
            continue
        if group and (line is None or used + 1 + len(line) > most):
            whole = "\n".join(group)
            yield from filter(None, (whole[i : i + most].strip() for i in range(0, len(whole), most))) if len(whole) > most else [whole]
            group, used = [], 0
        if line is not None:
            used += len(line) + bool(group)
            group.append(line)


def chunked_rows(df: DataFrame, text: str, keys: list[str], start: Callable[[], Callable[[str | None], Iterator[str]]], total: bool = False) -> DataFrame:
    """Rows: keys, chunk_no (from 1), chunk; with ``total`` also how many chunks the text has, where one without any has a null chunk. start: called once a task, gives what makes a text's chunks. A document's chunks are made in one pass
    over its row, so that nothing is shuffled."""
    schema = T.StructType([T.StructField(f"c{i}", df.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())] + [T.StructField("chunks", T.IntegerType())] * total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = start()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                own = [list(chunks(t)) or [None] * total for t in some.column(len(keys)).to_pylist()]
                many = [pa.array([len(x) for x in own for _ in x], pa.int32())] * total
                at = pa.array([i for i, x in enumerate(own) for _ in x], pa.int64())
                number = pa.array([n + 1 for x in own for n in range(len(x))], pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in some.columns[:-1]), number, pa.array([c for x in own for c in x], pa.string()), *many], schema.names)

    out = df.select(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keys)], F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"c{i}": k for i, k in enumerate(keys)})


Chunker = Callable[[], Callable[[str | None], Iterator[str]]]


def line_chunker(most: int) -> Chunker:
    return lambda: lambda t: chunks_of(t, most)


def token_chunker(most: int, tokenizer: str) -> Chunker:
    def start() -> Callable[[str | None], Iterator[str]]:
        own = loaded(tokenizer)
        encode = lambda x: own.encode(x, add_special_tokens=False).ids
        decode, apart = lambda ids: own.decode(ids, skip_special_tokens=False), units(tokenizer)
        return (lambda t: summed_chunks_of(t, most, apart, decode)) if apart else lambda t: token_chunks_of(t, most, encode, decode)

    return start


def line_chunks(df: DataFrame, text: str, most: int, keys: list[str]) -> DataFrame:
    """Chunks of whole lines up to ``most`` characters, as many lines as fit; longer lines are cut every ``most``."""
    return chunked_rows(df, text, keys, line_chunker(most))


def token_line_chunks(df: DataFrame, text: str, most: int, keys: list[str], tokenizer: str) -> DataFrame:
    """Chunks of whole lines up to ``most`` tokens of a file of the tokenizers library that each machine has, as many lines as fit; longer lines
    are cut every ``most`` ids and decoded."""
    return chunked_rows(df, text, keys, token_chunker(most, tokenizer))
