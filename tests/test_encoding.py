"""Blocks by quantiles, chunks and windows of ids, visibility, buffer shuffle, texts that are counted."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import encode, mixing, ordering, records

from .oracle import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["outlier", "low", "dense"])
def test_blocks_are_even_whatever_the_ids(spark, name):
    """One id far off leaves no block with more than twice the mean of the parts."""
    n = 200_000
    df = {"outlier": spark.range(n).union(spark.range(2**62, 2**62 + 1)), "low": spark.range(10**15, 10**15 + n).union(spark.range(5)), "dense": spark.range(n)}[name]
    rows = ordering.by_range(df, "id").groupBy("_block").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("_block").collect()
    assert all(x.b < y.a for x, y in zip(rows, rows[1:])) and len(rows) <= ordering.BLOCKS
    assert max(r.n for r in rows) <= 2 * n / ordering.PARTS


def test_blocks_of_few_rows(spark):
    df = spark.createDataFrame([(None,), (5,), (-(2**63),), (2**63 - 1,), (5,), (None,)], "x long")
    rows = sorted(((r.x is not None, r.x), r._block) for r in ordering.by_range(df, "x").collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows) and [b for (known, _), b in rows if not known] == [-1, -1]
    assert ordering.by_range(df.limit(0), "x").count() == 0
    out = ordering.running(df.withColumn("y", F.lit(2)), "x", [F.col("x")], {"a": F.lit(1), "b": F.col("y")}).collect()
    assert sorted((r.a, r.b) for r in out) == [(i, 2 * i) for i in range(6)]


class Loud:
    """A tokenizer of words, with the line feed as a word, that counts its calls."""

    calls = 0

    def encode(self, text):
        self.calls += 1
        return text.replace("\n", " \n ").split(" ")


def plain_token_chunks(text, most, encode_, decode):
    """Line by line, as long as the lines so far fit with the next one."""
    groups, current = [], []
    for line in [x.strip() for x in (text or "").splitlines() if x.strip()]:
        if current and len(encode_("\n".join([*current, line]))) > most:
            groups.append(current)
            current = []
        current.append(line)
    out = []
    for g in [*groups, *([current] if current else [])]:
        ids = encode_("\n".join(g))
        out += ["\n".join(g)] if len(ids) <= most else [x for i in range(0, len(ids), most) if (x := decode(ids[i : i + most]).strip())]
    return out


def test_token_chunks_by_loops():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bb c", " ", "\n", "\r\n", "x y z w v u", " "]) for _ in range(rnd.randint(0, 60)))
        own, most = Loud(), rnd.randint(1, 9)
        join = lambda ids: " ".join(ids)
        assert list(encode.token_chunks_of(text, most, own.encode, join)) == plain_token_chunks(text, most, own.encode, join)
    own = Loud()
    assert len(list(encode.token_chunks_of("a\n" * 4000, 1999, own.encode, " ".join))) == 4 and own.calls < 120


def test_token_chunks_of_documents(spark):
    """As by a loop over lines with the untouched library; no chunk has more tokens than the limit."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    ids = lambda x: own.encode(x, add_special_tokens=False).ids
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).unionByName(spark.createDataFrame([(-1, None), (-2, " \n"), (-3, "é" * 3000 + "\nb")], "doc_id long, text string"), allowMissingColumns=True)
    found: dict = {}
    for r in encode.token_line_chunks(docs, "text", 64, ["doc_id"], path).orderBy("doc_id", "chunk_no").collect():
        found.setdefault(r.doc_id, []).append(r.chunk)
        assert r.chunk_no == len(found[r.doc_id])
    for r in docs.collect():
        want = plain_token_chunks(r.text, 64, ids, lambda x: own.decode(x, skip_special_tokens=False))
        assert found.get(r.doc_id, []) == want
        lines = {x.strip() for x in (r.text or "").splitlines()}
        assert all(len(ids(c)) <= 64 for c in want if lines.issuperset(c.split("\n")) and c.split("\n")[0] in lines)  # parts of a line may have other ids by themselves


def test_windows_have_their_ids(spark):
    rnd = random.Random(1)
    rows = [(i, None if i == 4 else [rnd.randint(1, 9) for _ in range(n)]) for i, n in enumerate([3, 0, 1, 40, 5, 2, 0, 7])]
    joined = [x for _, ids in rows for x in [*(ids or []), *([0] if ids else [])]]
    df = spark.createDataFrame(rows, "k long, ids array<int>").repartition(3)
    for size in (1, 2, 5, 100):
        out = encode.id_windows(df, "ids", 0, size, "k", [F.col("k")]).collect()
        assert {r.window_no: r.ids for r in out} == {i: joined[i * size : (i + 1) * size] for i in range(len(joined) // size)}
    assert encode.id_windows(df, "ids", 0, 5, "k", [F.col("k")], most=2).count() == 2


def plain_buffer(n, size, draw, key):
    buffer, out = [], []
    for i in range(n):
        if len(buffer) < size:
            buffer.append(i)
        else:
            out.append(buffer[draw(i)])
            buffer[draw(i)] = i
    return out + sorted(buffer, key=lambda i: (key(i), i))


@pytest.mark.parametrize("n,size", [(0, 4), (3, 8), (8, 8), (50, 7), (200, 2), (20, 1), (20, 0)])
def test_buffer_by_a_loop(spark, n, size):
    from hashlib import md5

    key = lambda i: md5(f"s:{i}".encode()).hexdigest()
    df = spark.range(0, 3 * n, 3, 2)
    want = plain_buffer(n, size, lambda i: int(key(i)[:8], 16) * size >> 32, key) if size > 1 else list(range(n))
    rows = sorted(mixing.slot_shuffled(df, "id", size, "s").collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(n)) and [r.id // 3 for r in rows] == want


def test_visible_blocks_by_the_mask(spark):
    segments = [(0, 0, 5), (0, 5, 9), (0, 14, 1), (0, 15, 0), (1, 0, 16), (2, 3, 30)]
    out = {(r.bin, r.query_block, r.key_block): (r.visible, r.kind) for r in encode.visible_blocks(spark.createDataFrame(segments, "bin int, a int, n int"), ["bin"], "a", "n", 4).collect()}
    want: dict = {}
    for b, a, n in segments:
        for q in range(a, a + n):
            for k in range(a, q + 1):
                want[b, q // 4, k // 4] = want.get((b, q // 4, k // 4), 0) + 1
    assert out == {k: (v, "full" if v == 16 else "edge") for k, v in want.items()}


def test_sorted_json_is_pythons(spark):
    values = [{"b": 1, "a": {"z": None, "y": [1, {"k": "x, y: z", "é": 'q"\\ ,:'}, []]}, "": {}}, [{"b": True, "a": "中\n\t"}], "plain", 3, None, {"messages": "no"}, {"messages": [3, {"role": " u ", "content": " "}]}]
    rows = spark.createDataFrame([(json.dumps(v, ensure_ascii=False),) for v in values], "x string").select(records.sorted_json(F.parse_json("x")), records.counting_text(F.parse_json("x"))).collect()
    want = [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in values]
    assert [r[0] for r in rows] == want
    assert [r[1] for r in rows] == [v if isinstance(v, str) else w for v, w in zip(values, want)]
    shapes = ['{"text": " t ", "content": "c"}', '{"text": 3, "messages": [{"role": "user", "content": " q "}, {"content": 5}, {"role": "x"}]}', '{"content": " b ", "instruction": "a", "input": 7, "output": " "}']
    got = spark.createDataFrame([(x,) for x in shapes], "x string").select(records.counting_text(F.parse_json("x"))).collect()
    assert [r[0] for r in got] == [" t ", "user: q\n5", "a\nb"]


def test_queries_without_sql(spark):
    assert plans.QUERIES["token_line_chunks"](spark, SMALL).count() > 0 and "token_line_chunks" not in plans.ORACLES
    same(spark, plans.QUERIES["packed_visibility"], plans.ORACLES["packed_visibility"], SMALL)


def test_lines_are_read_once(monkeypatch):
    """Where a line's tokens don't depend on its neighbours no text goes to the library more than once, and ids and chunks are those of the untouched library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.functions import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), tokenizers.Units(Tokenizer.from_file(path))
    ids, decode = lambda x: plain.encode(x, add_special_tokens=False).ids, lambda x: plain.decode(x, skip_special_tokens=False)
    assert tokenizers.units(path) is not None
    rnd = random.Random(3)
    signs = ["a", "Zoë", "'s", "1", "!", ".", "\t", "  ", " ", "\xa0", "\x1c", "　", "中文", "，", "<|endoftext|>", "\n", "\r\n", "́", "�", "🙂"]
    for _ in range(400):
        text, most = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))), rnd.randint(1, 12)
        assert list(encode.summed_chunks_of(text, most, own, decode)) == plain_token_chunks(text, most, ids, decode)
        lines = [x for x in map(str.strip, text.splitlines()) if x]
        assert own.counts(lines) == [len(ids(x)) for x in lines] and [own.ids(x) for x in lines] == [ids(x) for x in lines]
    read = []
    real = tokenizers.Units.learn
    monkeypatch.setattr(tokenizers.Units, "learn", lambda self, some: (read.extend(some), real(self, some)))
    monkeypatch.setattr(encode, "loaded", lambda _: type("None", (), {"decode": plain.decode, "encode": None}))
    tokenizers.units.cache_clear()
    text = "\n".join(f"word{i} and more of it" for i in range(2000))
    assert len(list(encode.token_chunker(100, path)()(text))) > 50 and len(read) == len(set(read)) == 2004


def test_tokenizers_whose_lines_are_not_apart(tmp_path):
    import public_tokenizers

    from tessera.functions import tokenizers

    file = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    token = file["added_tokens"][0]
    changes = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": file["pre_tokenizer"] | {"use_regex": False}}, {"added_tokens": [token | {"lstrip": True}]}, {"added_tokens": [token | {"content": "a\nb", "id": len(file["model"]["vocab"])}]}, {"pre_tokenizer": None}]
    for i, change in enumerate(changes):
        (tmp_path / f"{i}.json").write_text(json.dumps(file | change), encoding="utf-8")
        assert tokenizers.units(str(tmp_path / f"{i}.json")) is None


def test_windows_make_ids_once(spark):
    """Ids are made once, after records have their places, and by no regex where there is no special token; counts don't make them."""
    from tessera.functions import text as t
    from tessera.functions.tokenizers import CHAR

    special = {x: i for i, x in enumerate((t.BOS, t.EOS, t.PAD), 0x110000)}
    texts = ["", None, "aé中🙂\n\x00", t.BOS + "x" + t.PAD, "<｜", t.EOS[:-1], t.EOS * 2, "plain " * 30]

    def ids(x):
        out = []
        while x:
            token = next((s for s in special if x.startswith(s)), x[0])
            out.append(special.get(token, ord(token[0])))
            x = x[len(token) :]
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    rows = df.select("text", CHAR.ids(F.col("text")).alias("ids"), t.char_count("text").alias("n")).collect()
    assert [(r.ids, r.n) for r in rows] == [(None, None) if r.text is None else (ids(r.text), len(ids(r.text))) for r in rows]
    joined = [i for x in texts if x for i in [*ids(x), special[t.EOS]]]
    for size in (1, 4, 7):
        made = spark.sparkContext.accumulator(0)

        @F.udf("array<int>")
        def slow(x):
            made.add(1)  # noqa: B023
            return ids(x)

        out = encode.id_windows(df, slow("text"), special[t.EOS], size, "k", [F.col("k")], tokens=t.char_count("text")).collect()
        assert {r.window_no: r.ids for r in out} == {i: joined[i * size : (i + 1) * size] for i in range(len(joined) // size)}
        assert made.value == sum(1 for x in texts if x)


def test_visible_blocks_hold_no_pairs(spark):
    """Pairs are made row by row and never grouped; segments that overlap or leave gaps count as by the mask."""
    segments = [(None, 0, 9), (None, 6, 10), (1, 2, 1), (1, 20, 11), (1, 40, 0), (2, 3, 2), (2, 0, 3)]
    df = encode.visible_blocks(spark.createDataFrame(segments, "bin int, a int, n int"), ["bin"], "a", "n", 4)
    want: dict = {}
    for b, a, n in segments:
        for q in range(a, a + n):
            for k in range(a, q + 1):
                want[b, q // 4, k // 4] = want.get((b, q // 4, k // 4), 0) + 1
    assert sorted(map(repr, ((r.bin, r.query_block, r.key_block, r.visible) for r in df.collect()))) == sorted(repr((*k, v)) for k, v in want.items())
    assert not [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x and "_block" in x]
