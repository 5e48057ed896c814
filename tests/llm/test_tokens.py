import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from tokenizers import Tokenizer

from tessera.llm import bpe, library, packing, pieces, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ROWS = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "", None), (None, "it's 12 é\n\n ok", "z"), (5, "word " * 5000, "z")]
SCHEMA = "doc_id long, text string, ids string"


def odd_texts(n=3000, seed=5):
    rnd = random.Random(seed)
    signs = "  \n\t'stmdrevlSab19!?%é　\x85中🙂\x1c"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(n)] + ["", "x" * 3000, "abc" * 4000, "'" * 99, " " * 999, "a <|endoftext|> b"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def test_pieces_are_the_patterns_matches():
    texts = odd_texts(1000)
    joined = "".join(texts)
    lengths = np.array([len(t) for t in texts])
    firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
    begin = pieces.starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), firsts)
    want, at = [], 0
    for t in texts:
        want += [at + m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)]
        at += len(t)
    assert begin.tolist() == want


def test_scans_of_any_width_agree():
    symbols = np.random.default_rng(1).integers(0, 16, 5000)
    state, want = 0, []
    for s in symbols:
        want.append(state)
        state = pieces.step(state, int(s))[0]
    assert pieces.states(symbols, 7).tolist() == pieces.states(symbols, 64).tolist() == want


def test_ids_are_the_librarys(reference, tokenizer):
    texts = odd_texts()
    for own, encode in ((bpe.encoder(RANKS), reference.encode_ordinary), (library.text_encoder(JSON), lambda t: tokenizer.encode(t, add_special_tokens=False).ids)):
        ids, offsets = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [encode(t) for t in texts]


def test_every_code_point(reference, tokenizer):
    """Doubled, and after a letter, a number, a sign, a space and letters of another script: no code point has other ids than the library gives."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for own, encode in ((bpe.encoder(RANKS), reference.encode_ordinary), (library.text_encoder(JSON), lambda t: tokenizer.encode(t, add_special_tokens=False).ids)):
        for a in range(0, len(points), 1 << 13):
            text = "\n".join(f"a{c}1{c}#{c} {c}{c}\u6992{c}\uc000" for c in points[a : a + (1 << 13)])
            assert np.array_equal(own.encode([text])[0], encode(text)), hex(a)


def test_cache_starts_anew(reference):
    own = pieces.PieceEncoder(bpe.Merger(bpe.load_ranks(RANKS)), most=50)
    for t in odd_texts(200):
        assert own.encode([t])[0].tolist() == reference.encode_ordinary(t)


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("together", [True, False])
def test_pieces_with_one_key_have_their_own_ids(reference, together):
    """Such a word and its complement have the same polynomial modulo 2^64 from some length on."""
    texts = [t for n in (1024, 2048, 4096) for t in (thue_morse(n), thue_morse(n, "b", "a"), "x " + thue_morse(n, "b", "a"))]
    last = [pieces.keys(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0])) for t in texts[-3:-1]]
    assert last[0] == last[1]
    plain = Tokenizer.from_file(JSON)
    for merge, encode in ((bpe.Merger(bpe.load_ranks(RANKS)), reference.encode_ordinary), (library.LibraryMerger(JSON), lambda t: plain.encode(t, add_special_tokens=False).ids)):
        own = pieces.PieceEncoder(merge)
        for _ in range(2):
            for some in [texts] if together else [[t] for t in texts]:
                ids, offsets = own.encode(some)
                assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [encode(t) for t in some]


def test_all_keys_alike(reference, monkeypatch):
    monkeypatch.setattr(pieces, "keys", lambda points, begin: np.zeros(len(begin), np.uint64))
    own, texts = pieces.PieceEncoder(bpe.Merger(bpe.load_ranks(RANKS))), odd_texts(100)
    for some in (texts, texts[::-1]):
        ids, offsets = own.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [reference.encode_ordinary(t) for t in some]


def test_encode_and_decode_rows(spark, reference):
    df = spark.createDataFrame(ROWS, SCHEMA)
    encoded = bpe.encode_texts(df, RANKS, decoded_col="back")
    got = sorted((r.doc_id or 0, list(r.ids), bytes(r.back)) for r in encoded.collect())
    assert got == sorted((i or 0, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in ROWS)
    assert [bytes(r.decoded) for r in bpe.decode_ids(encoded.drop("back"), RANKS).collect()] == [bytes(r.back) for r in encoded.collect()]
    assert bpe.encode_texts(df.limit(0), RANKS).count() == 0


def test_query_of_encoding(spark, reference):
    from tessera.llm import queries

    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, SF).collect()}
    for r in queries.op7_byte_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_cuts_are_class_lengths():
    for n, parts in enumerate(packing.cuts(2048)):
        assert sum(parts) == n and all(2048 // (2048 // p) == p for p in parts)


def test_query_of_packing(spark, tokenizer):
    from tessera.llm import queries

    full = {r.doc_id: np.append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids), 1).astype("<u4") for r in queries.documents(spark, SF).collect()}
    rows = queries.op8_harmonic_packing(spark, SF).collect()
    seen, places = {i: np.zeros(len(x), int) for i, x in full.items()}, {}
    for r in rows:
        seen[r.doc_id][r.start : r.start + r.length] += 1
        assert zlib.crc32(full[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(full[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((x == 1).all() for x in seen.values())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(places) == list(range(len(places)))
    assert sum(r.length for r in rows) > 0.97 * 2048 * len(places)


def test_packing_edges(spark, tokenizer):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = packing.pack(df, JSON, capacity=64, end_id=1).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(df.limit(0), JSON).count() == 0
    assert packing.pack(df.where("text is null"), JSON, end_id=None).count() == 0
    named = df.select("doc_id", "text").toDF("start", "ids")
    assert packing.pack(named, JSON, capacity=64, id_col="start", text_col="ids").count() == len(rows)
    assert bpe.encode_texts(named.toDF("ids", "text"), RANKS, id_col="ids").count() == len(ROWS)


def test_plan_beyond_broadcast_packs_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"word {i} " * (i % 40)) for i in range(200)], "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, packing.pack(df, JSON, capacity=32).collect()))
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    got = sorted(map(tuple, packing.pack(df, JSON, capacity=32).collect()))
    # the same documents in the same tasks have the same pieces in the same places
    assert got == want


def test_query_of_token_files(spark, tokenizer):
    from tessera.llm import queries

    at = 0
    texts = sorted((r.doc_id, r.text or "") for r in queries.documents(spark, SF).collect())
    found = {r.doc_id: r for r in queries.op10_token_files(spark, SF).collect()}
    for i, t in texts:
        ids = np.append(np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4"), 0).astype("<u4")
        assert tuple(found[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_file_edges(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    manifest = token_files.write_tokens(df, JSON, str(tmp_path / "t"), parts=3)
    rows = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 5] and rows[-1].start + rows[-1].n_tokens == sum(p["ids"] for p in manifest["parts"])
    assert json.loads((tmp_path / "t/manifest.json").read_text()) == manifest and manifest["type"] == "<u2"
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".")]
    token_files.write_tokens(df.limit(0), JSON, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    """Where files can't be mapped, only ranges of them are read, and the rows are the same."""
    df = spark.createDataFrame([(i, f"word {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    token_files.write_tokens(df, JSON, str(tmp_path / "t"), parts=3)
    rows = sorted(map(tuple, token_files.read_tokens(spark, str(tmp_path / "t")).collect()))
    for name in ("part-000000.bin", "part-000000.idx"):
        kind = "<u2" if name.endswith("bin") else "<u8"
        whole = np.fromfile(tmp_path / "t" / name, kind)
        monkeypatch.setattr(token_files.pyarrow.fs, "LocalFileSystem", type("Other", (), {}))
        monkeypatch.setattr(token_files, "place", lambda p: (FileSystem.from_uri(f"file://{p}")[0], p))
        read = token_files.slices(str(tmp_path / "t" / name), kind)
        monkeypatch.undo()
        assert not isinstance(read(3, 20), np.memmap) and read(3, 20).tolist() == whole[3:20].tolist() and len(read(5, 5)) == 0
    assert [r[0] for r in rows] == list(range(300))


def test_another_attempt_has_put_the_file(tmp_path):
    class NoReplace:
        def __init__(self):
            self.own = LocalFileSystem()

        def move(self, a, b):
            if self.get_file_info(b).type == FileType.File:
                raise OSError("there")
            self.own.move(a, b)

        def __getattr__(self, name):
            return getattr(self.own, name)

    for i in range(2):
        (tmp_path / f".own{i}").write_bytes(b"x")
        token_files.put_in_place(NoReplace(), str(tmp_path / f".own{i}"), str(tmp_path / "part"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["part"]


def test_repeated_ids_over_parts(spark, tmp_path):
    df = spark.createDataFrame([(7, f"t{i}") for i in range(40)] + [(None, "n")] * 3, "doc_id long, text string").repartition(4)
    token_files.write_tokens(df, JSON, str(tmp_path / "t"), parts=4)
    rows = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 3 + [7] * 40 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "it's <|endoftext|>'s <|endoftext", " \n <|endoftext|> \n ", "<|<|endoftext|>|>"]


def test_added_tokens_are_the_librarys(tmp_path):
    rnd = random.Random(3)
    texts = odd_texts(300) + MARKED + ["<|endoftext|>".join(odd_texts(rnd.randrange(1, 6), i)) for i in range(300)]
    plain = Tokenizer.from_file(JSON)
    assert plain.encode(MARKED[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    told = json.loads(open(JSON).read())
    told["added_tokens"][0] |= {"lstrip": True, "rstrip": True}
    (tmp_path / "strips.json").write_text(json.dumps(told))
    for path in (JSON, str(tmp_path / "strips.json")):
        plain = Tokenizer.from_file(path)
        ids, offsets = library.text_encoder(path).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    ids, offsets = library.text_encoder(JSON).encode(["", ""])
    assert len(ids) == 0 and offsets.tolist() == [0, 0, 0]


def test_added_tokens_are_packed_and_written(spark, tmp_path):
    plain = Tokenizer.from_file(JSON)
    df = spark.createDataFrame(list(enumerate([*MARKED, "plain"])), "doc_id long, text string")
    full = [plain.encode(t, add_special_tokens=False).ids + [1] for t in [*MARKED, "plain"]]
    got = {i: {} for i in range(len(full))}
    for r in packing.pack(df, JSON, capacity=8, end_id=1).collect():
        got[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
        assert r.doc_tokens == len(full[r.doc_id])
    assert [[x for _, p in sorted(own.items()) for x in p] for own in got.values()] == full
    token_files.write_tokens(df, JSON, str(tmp_path / "t"), end_id=1, parts=2)
    at = 0
    for r in sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect()):
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(full[r.doc_id]), full[r.doc_id])
        at += r.n_tokens
