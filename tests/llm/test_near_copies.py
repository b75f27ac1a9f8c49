import random
from itertools import combinations

import corpus_pipeline as P
from stranda.llm import near_copies as N


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts, least=0.8):
    sets, parent = [plain(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited_texts():
    """Texts with edited copies on both sides of the threshold, chains of edits, and a passage that many share."""
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(3000)
    shared = " ".join(word() for _ in range(40))
    texts = [None, "", " \n", "one", "One", "one two three", "one two three four five", "one two three four five six"]
    for k in range(25):
        base = [word() for _ in range(rng.randint(40, 150))]
        texts.append(" ".join(base) + (" " + shared if k % 2 else ""))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join(copy) + (" " + shared if k % 2 else ""))
            if rng.random() < 0.4:
                base = copy
    return texts


def test_components_match_brute_force(spark):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in N.rooted(docs, 5, 0.8, "text", "doc_id").collect()}
    want = brute(texts)
    assert len(set(want)) < len(texts) - 30  # there is something to find
    assert [got[i] for i in range(len(texts))] == want


def test_order_of_shingles_never_changes_the_result(spark, monkeypatch):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(N, "FREQUENT", 1 << 30)
    got = {r.doc_id: r.component_id for r in N.rooted(docs, 5, 0.8, "text", "doc_id").collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_stage_drops_edited_copies(spark):
    rng = random.Random(4)
    rows = []
    for k in range(30):
        base = ["v%d" % rng.randrange(5000) for _ in range(120)]
        rows.append((k, " ".join(base)))
        base[30 + k] = "edited"
        base[80] = "too"
        rows.append((100 + k, " ".join(base)))
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = P.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(30))


def test_fingerprints_find_candidates_by_the_byte_index(spark, monkeypatch):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = N.shingle_sets(docs, 5, 0.8, "text", "doc_id")
    made = {r.doc_id: r for r in sets.collect()}
    for i, t in enumerate(texts):
        found = N.shingles((t or "").encode())
        assert made[i].fp == N.simhash.signed(N.simhash.from_hashes(found)) and made[i].set_id == N.set_id(found)
    # The links that the index finds for certain are found without the join over shingles.
    monkeypatch.setattr(N, "postings", lambda rows, *_: spark.createDataFrame([], "key bigint, id bigint, root bigint, n int, place int"))
    pairs = {frozenset(r) for r in N.links(sets, docs).collect()}
    by_set = {made[i].set_id: plain(t) for i, t in enumerate(texts)}
    assert pairs and all(len(by_set[a] & by_set[b]) >= 0.8 * len(by_set[a] | by_set[b]) for a, b in pairs)


def test_pairs_are_verified_in_parts_that_free_their_tables(spark, monkeypatch):
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts, checked = [], N.checked
    monkeypatch.setattr(N, "checked", lambda *args: parts.append(1) or checked(*args))
    monkeypatch.setattr(N, "PART_BYTES", 20_000)
    monkeypatch.setattr(N, "PART_SHARE", 0)
    before = N.common.scratch_count()
    got = {r.doc_id: r.component_id for r in N.rooted(docs, 5, 0.8, "text", "doc_id").collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts) and len(parts) > 3
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in N.common.made_since(before)]
    assert {"near-pairs", "near-sets", "near-texts", "near-postings", "near-distinct", "near-rest", "near-rooted"}.isdisjoint(left)


def test_rows_of_one_document_with_texts_of_one_set_are_one(spark):
    docs = spark.createDataFrame([(1, "One two"), (1, "one  two"), (1, "one  two"), (2, "one two"), (None, None), (None, None), (3, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id, (r.text or "").lower().split()) for r in N.kept(docs).collect()) == [(1, ["one", "two"]), (3, [])]
