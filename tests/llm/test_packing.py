import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from stranda.llm import encoders
from stranda.llm import packing as P

PATH = encoders.default_path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, start string, rank int, offset double"


def check(rows, pieces, window=P.WINDOW):
    """Every id in just one piece, sequences gapless and within the window; the padding."""
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, text in rows:
        want[i].append(t.encode(text or "", add_special_tokens=False).ids + [0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for i, docs in want.items():
        if len(docs) > 1:  # repeated rows can't be told apart
            assert sum(p.length for p in by_doc[i]) == sum(map(len, docs))
            continue
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(docs[0])
            assert p.ids_crc32 == zlib.crc32(np.array(docs[0][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(docs[0])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += window - at
    assert set(by_sequence) == set(range(len(by_sequence)))
    return padding


def test_pieces_cover_documents_and_only_the_last_sequence_is_padded(spark):
    rng = random.Random(10)
    texts = [None, "", "one", "word " * 1023, "word " * 1022, "long text " * 4000] + ["w " * rng.randint(1, 1500) for _ in range(150)] + ["same " * 700] * 40
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "clash", 1, 0.5) for i, t in rows], SCHEMA).repartition(5)
    assert check(rows, P.pack(docs, PATH).collect()) < P.WINDOW


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, "w " * 1100)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert check(rows, P.pack(docs, PATH).collect()) < P.WINDOW
    assert P.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("window", [12, 30])
def test_combinations_are_those_of_brute_force(window):
    lengths = [k for k in range(1, window) if k % 5 != 3]
    have = set(lengths)
    want = {(a, window - a) for a in have if window - a in have and 2 * a <= window}
    want |= {tuple(sorted((a, b, window - a - b))) for a in have for b in have if window - a - b in have}
    got = P.combinations_filling(window, lengths)
    assert set(got) == want and len(got) == len(want)


def test_solution_satisfies_the_conditions_of_least_squares():
    rng = random.Random(11)
    counts = {k: rng.randint(0, 40) for k in range(1, 16)}
    combos = P.combinations_filling(16, list(counts))
    x = np.array(P.solve(combos, counts))
    a = np.array([[c.count(k) for c in combos] for k in counts], dtype=float)
    slope = a.T @ (np.array(list(counts.values())) - a @ x)
    limit = 1.01 * P.TOLERANCE * max(counts.values())
    assert x.min() >= 0 and slope.max() <= limit and np.abs(slope[x > 0]).max() <= limit


def test_solution_over_all_lengths_of_a_window_satisfies_them_too():
    rng = random.Random(14)
    counts = {k: rng.randint(1, 200) for k in range(1, P.WINDOW)}
    combos = P.combinations_filling(P.WINDOW, list(counts))
    x = P.solve(combos, counts)
    left = {k: float(n) for k, n in counts.items()}
    for times, combo in zip(x, combos, strict=True):
        for k in combo:
            left[k] -= times
    slope = np.array([sum(left[k] for k in combo) for combo in combos])
    limit = 1.01 * P.TOLERANCE * max(counts.values())
    assert min(x) >= 0 and slope.max() <= limit and np.abs(slope[np.array(x) > 0]).max() <= limit


def test_plan_places_each_rank_once():
    rng = random.Random(12)
    counts = {k: rng.randint(1, 30) for k in range(1, 64)} | {40: 900}
    plan = P.Plan.make(counts, 64)
    filled = Counter()
    for k, n in counts.items():
        for s, o in zip(*plan.place(k, np.arange(n)), strict=True):
            for j in range(k):
                filled[int(s) + (int(o) + j) // 64, (int(o) + j) % 64] += 1
    total = sum(k * n for k, n in counts.items())
    assert set(filled.values()) == {1} and len(filled) == total
    assert max(s for s, _ in filled) == -(-total // 64) - 1


def test_packed_sequences_hold_every_id(spark):
    rng = random.Random(13)
    rows = list(enumerate(["long text " * 3000, "", "word " * 1023, *("w%d " % i * rng.randint(1, 1500) for i in range(60))]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    pieces = P.pack(docs, PATH).cache()
    t = Tokenizer.from_file(PATH)
    want = {i: t.encode(text, add_special_tokens=False).ids + [0] for i, text in rows}
    packed = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in P.sequences(pieces).collect()}
    found = defaultdict(list)
    for p in sorted(pieces.collect(), key=lambda p: p.start):
        assert p.ids_crc32 == zlib.crc32(p.ids)
        found[p.doc_id] += packed[p.sequence_id][p.offset : p.offset + p.length]
    assert found == want and sum(map(len, packed.values())) == sum(map(len, want.values()))
