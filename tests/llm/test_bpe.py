import hashlib
import random

import pyarrow as pa
from tokenizers import Tokenizer

from stranda.llm import bpe as B
from stranda.llm import encoders

PATH = encoders.default_path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, n_tokens string, ids int"


def texts():
    rng = random.Random(7)
    words = "the The running don't WE'LL naïve Straße 2024 #!? <|endoftext|> a<|endoftext|>b 日本 \n \t  x  y 's é".split(" ")
    return [None, "", " ", "\n\n", " lead", "trail ", "a  b\n\n c\t\n", "tab\t x", "a b　c\x0bd\x1ce\x85f", "x" * 500, "ab" * 4000, "é" * 300, "<|endoftext|>", " <|endoftext|> b", *(" ".join(rng.choice(words) for _ in range(200)) for _ in range(20))]


def test_matches_the_library(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    t = Tokenizer.from_file(PATH)
    lexicon = B.compile_lexicon(docs, PATH, words=50)
    got = {r.doc_id: r for r in B.digests(docs, PATH, lexicon).collect()}
    ids = {r.doc_id: r.ids for r in B.encode(docs, PATH, lexicon).collect()}
    back = {r.doc_id: r.decoded for r in B.decode(B.encode(docs, PATH, lexicon), PATH).collect()}
    for i, text in rows:
        want = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(want, skip_special_tokens=False)
        assert ids[i] == want and back[i] == decoded == (text or "")
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_lexicon_holds_just_its_words_with_shared_suffixes(tmp_path):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    words = {(s + e).encode(): [rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for s in stems for e in ("", "ing", "tion")}
    (tmp_path / "l").write_bytes(B.Lexicon.build(words))
    lexicon = B.Lexicon(str(tmp_path / "l"))
    assert all(lexicon.ids(w) == ids for w, ids in words.items())
    every = [*words, b"", b"zz", b"a\xff", b"ab" * 40]
    places = lexicon.places(pa.array([w.decode("latin-1") for w in every if max(w, default=0) < 128], pa.large_string()))
    assert [lexicon.id[lexicon.offset[p] : lexicon.offset[p + 1]].tolist() if p >= 0 else None for p in places.tolist()] == [words.get(w) for w in every if max(w, default=0) < 128]
    assert all(lexicon.ids(x) is None for w in words for x in (w + b"z", w[:-1] + b"\xff", b"") if x not in words)
    # As many states as there are different sets of endings.
    tails = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert lexicon.n_states == len(tails)
    (tmp_path / "e").write_bytes(B.Lexicon.build({}))
    assert B.Lexicon(str(tmp_path / "e")).ids(b"a") is None


def test_long_and_short_merging_agree():
    merges, rng = B.Merges(PATH), random.Random(9)
    for _ in range(200):
        word = "".join(rng.choice("aeinorstu ") for _ in range(rng.randint(2, 60))).encode()
        assert merges.merge(word) == merges._merge_long([merges.of_byte[b] for b in word])
    words = [" thing", "a", "aaaaaaaaaaaa", "éèê", *("".join(rng.choice("aeinorstuéß") for _ in range(rng.randint(1, 40))) for _ in range(2000))]
    ids, at = merges.merge_all(pa.array(words, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [merges.merge(w.encode()) for w in words]


def test_repeated_rows_count_each(spark):
    docs = spark.createDataFrame([(1, "same words again", "", 1)] * 5 + [(None, None, None, None)], SCHEMA)
    got = B.digests(docs, PATH, B.compile_lexicon(docs, PATH)).groupBy("doc_id", "ids_sha256").count().collect()
    assert sorted(r["count"] for r in got) == [1, 5]


def test_no_rows_and_little_memory(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert B.digests(none, PATH, B.compile_lexicon(none, PATH)).count() == 0
    coder = B.Coder(B.Merges(PATH), None)
    for t in texts():
        assert coder.decode(coder.ids(t or "")) == (t or "")
        assert coder.digests(pa.array([t]))[0] == [len(coder.ids(t or ""))]
