import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from stranda.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_covering_sets_avoid_any_three_positions():
    assert len(S.SETS) == 14
    for bad in combinations(range(8), 3):
        assert any(not set(bad) & set(s) for s in S.SETS)


def test_query_matches_brute_force(spark):
    base = "Word%d the of and more words here again that follow one another in a long line of text %d"
    texts = [None, "", " \n", "one", "One TWO", "one two three", "ÄÖ x y z"] + [base % (i // 4, i % 2) + " tail" * (i % 3) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, fp int, root string")
    got = {r.doc_id: (r.fp, r.component_id) for r in S.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i][0] & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [got[i][1] for i in range(len(texts))] == brute(fps)


def test_chains_and_clusters_of_fingerprints(spark):
    rng = random.Random(5)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.append(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    fps = sorted(set(fps), key=S.signed)
    want = brute(fps)
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in S.components(S.links(df)).collect()}
    assert [roots.get(S.signed(f), S.signed(f)) for f in fps] == [S.signed(fps[w]) for w in want]


@pytest.mark.parametrize("long", [10_000, 40, 7])
def test_forest_of_short_and_split_lists_alike(monkeypatch, long):
    monkeypatch.setattr(S, "LONG", long)
    rng = random.Random(2)
    fps = sorted({rng.getrandbits(12) for _ in range(300)})
    a, b = S.forest(np.array(fps, dtype=np.int64))
    want = brute(fps)
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [got.get(f, f) for f in fps] == [fps[w] for w in want]


def test_long_lists_are_posted_again(spark, monkeypatch):
    monkeypatch.setattr(S, "LONG", 5)
    rng = random.Random(3)
    fps = sorted({rng.getrandbits(11) for _ in range(150)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in S.components(S.links(df)).collect()}
    assert [roots.get(f, f) for f in fps] == [fps[w] for w in brute(fps)]


def test_a_list_over_its_real_limit():
    """More fingerprints than a list may hold, in pairs that differ in one or two bits, and singles."""
    rng = random.Random(4)
    base = [rng.getrandbits(23) & ~3 for _ in range(9000)]
    fps = sorted({f << 1 for f in base} | {f << 1 | 2 for f in base})
    assert len(fps) > S.LONG
    a, _ = S.forest(np.array(fps, dtype=np.int64))
    linked = set(a.tolist())
    assert all(((f << 1) in linked) or ((f << 1 | 2) in linked) for f in base)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id bigint, text string")
    assert [r.component_id for r in S.near_duplicates(rows).collect()] == [1, 1]


def test_no_rows_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(3, "a b c d")] * 3 + [(None, "a b c d")], "doc_id bigint, text string")
    assert [r.component_id for r in S.near_duplicates(rows).collect()] == [3] * 4
