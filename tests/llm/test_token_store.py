import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stranda.llm import common, encoders
from stranda.llm import token_store as S

PATH = encoders.default_path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, start string, n_tokens int, part int"


def texts():
    rng = random.Random(6)
    words = "the of and a running tokens don't WE'LL naïve Straße 2024 ﬁ ümlaut <|endoftext|> x<|startoftext|>y #!? \x1c\x85 word word".split(" ")
    long = " ".join(rng.choice(words) for _ in range(5000))
    return [None, "", " \n\t ", "Hello, World", "a b   c", "日本語 テキスト", "é ́x", "x" * 3000, long, long + " tail", "head " + long, long, "İstanbul ΣΑΣ", "İ. İ,", "য়, ড়. क़.", "יִ, \u0344.x"]


def expected(rows):
    t = Tokenizer.from_file(PATH)
    start, out = 0, []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digests_and_ids_match_the_library(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in reversed(rows)], SCHEMA).repartition(3)
    path = S.write(docs, common.scratch(spark, "t"), PATH)
    store = S.TokenStore(spark, path)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.digests().collect())
    assert got == expected(rows)
    whole = {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in store.ids().collect()}
    assert whole == {i: c for i, _, _, c in got}
    n = store.chunks.count()
    assert n == store.chunks.select("digest").distinct().count()
    stored = store.chunks.agg({"n_ids": "sum"}).first()[0]
    assert stored < sum(g[2] for g in got) * 0.5  # shared passages are stored once


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(1, "some text here", "", 1, 1)], SCHEMA)
    path = S.write(docs, common.scratch(spark, "t"), PATH)
    store = S.TokenStore(spark, path)
    store.chunks = store.chunks.selectExpr("digest", "n_ids", "overlay(payload placing unhex('ff') from 1) as payload")
    with pytest.raises(Exception, match="damaged"):
        store.digests().collect()


def test_null_ids_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(2, "b", "", 1, 1), (None, "n", "", 1, 1), (2, "b", "", 1, 1), (1, None, None, None, None)], SCHEMA)
    got = S.TokenStore(spark, S.write(docs, common.scratch(spark, "t"), PATH)).digests().collect()
    assert sorted(r.start for r in got) == [0, 2, 3, 5] and {r.doc_id: r.start for r in got}[None] == 0
    none = spark.createDataFrame([], SCHEMA)
    assert S.TokenStore(spark, S.write(none, common.scratch(spark, "t"), PATH)).digests().count() == 0


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40_000, 20_000)
    ends = S.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= S.LEAST and sizes.max() <= S.MOST + S.LEAST
    moved = S.cuts(np.concatenate([ids[:57], ids]))
    assert len({e - 57 for e in moved} & set(ends)) > 0.9 * len(ends)
    assert S.cuts(ids[:1]) == [1]


def test_encoder_is_exact_with_little_memory():
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        t = Tokenizer.from_file(encoders.default_path(name))
        small = encoders.Encoder(encoders.default_path(name), drops, most=5)
        for text in [*texts(), "a 　 b", "end  ", "\n\n x\t\ty \r\n", "a\x0bb\x0c c", "Ḧ h̤ H̱ K Å A\u030a", "it's IT'S x'tea,foo.bar ...", "Été, ÀÉ. Straße,", "one,two. 3.5,x", ", .a", "a,,b..", "x́. y"]:
            text = text or ""
            assert np.frombuffer(small.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_encoder_takes_slices_and_nulls():
    column = pa.array(["Çà et là", None, "", "Übung, SCHÖN", "plain Words here"] * 4, pa.string())
    t = Tokenizer.from_file(PATH)
    coder = encoders.Encoder(PATH, True)
    for at in (0, 3, 11):
        got = [x.tolist() for x in coder.encode_column(column.slice(at, 7))]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in column.slice(at, 7).to_pylist()]


def test_crcs_join():
    rng = random.Random(1)
    parts = [rng.randbytes(rng.choice([0, 4, 400])) for _ in range(50)]
    assert encoders.join_crcs([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_stops_after_letters_that_normalisation_changes():
    import unicodedata

    changed = [c for c in map(chr, range(0x20, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and (unicodedata.normalize("NFC", c) != c or len(c.lower()) > 1 or unicodedata.combining(c))]
    other = [chr(c) for c in [*range(0x20, 0x1000), *range(0x1000, 0xD800, 13)]]
    pieces = [f"{c}. x{c}, a{c}b" for c in changed] + [f"{c}, {c}.y" for c in other]
    t = Tokenizer.from_file(PATH)
    coder = encoders.Encoder(PATH, True)
    for k in range(0, len(pieces), 500):
        got = coder.encode_column(pa.array(pieces[k : k + 500]))
        assert [g.tolist() for g in got] == [e.ids for e in t.encode_batch(pieces[k : k + 500], add_special_tokens=False)]


def test_roots_over_runs_are_those_over_all(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    docs = spark.createDataFrame([(i, f"t{i}", "", 1, 1) for i in range(37)], SCHEMA)
    store = S.TokenStore(spark, S.write(docs, common.scratch(spark, "t"), PATH))
    roots = {}
    for r in store.recipes.orderBy("part", "seq").collect():
        roots.setdefault(r.part, []).append(bytes(r.root))
    got = {r.part: (bytes(r.root), r.n_docs) for r in store.manifest.collect()}
    assert got == {p: (S.merkle(d), len(d)) for p, d in roots.items()} and sum(n for _, n in got.values()) == 37
