import hashlib
import random

import numpy as np
import pytest

from stranda.llm import line_dedup as L

SCHEMA = "doc_id bigint, text string, n_lines string, kept_text int"


def brute(texts, least):
    keys = [[L.line_key(x) for x in (t or "").encode().split(b"\n")] for t in texts]
    count = {}
    for ks in keys:
        for k in set(ks):
            count[k] = count.get(k, 0) + 1
    out = []
    for t, ks in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((t or "").encode().split(b"\n"), ks, strict=True) if not (k and count[k] >= least)]
        out.append((len(ks), len(ks) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out


TEXTS = [None, "", "\n", " A b \nx", "a B\ny\n\n", "a b", "Ä\na b\t", "ä", "a b\na b\nz", "x\n" * 3, "long " * 50_000 + "\na b", "ä"]


@pytest.mark.parametrize("limit, shard_keys", [(L.EXACT_BYTES, L.SHARD_KEYS), (-1, L.SHARD_KEYS), (-1, 1), (L.EXACT_BYTES, 1)])
def test_matches_brute_force_broadcast_and_joined(spark, limit, shard_keys):
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(TEXTS)], SCHEMA)
    state = L.LineDedup(spark, min_docs=3, exact_bytes=limit, shard_keys=shard_keys).insert(docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in state.digests(docs).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS, 3)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "p\nq", "", 1)] * 3 + [(1, "q", "", 1)], SCHEMA)
    state = L.LineDedup(spark, min_docs=3).insert(docs)
    assert sorted(r.kept_text for r in state.dropped_lines(docs).collect()) == ["", "", "", ""]
    none = spark.createDataFrame([], SCHEMA)
    assert L.LineDedup(spark).insert(none).digests(none).count() == 0


@pytest.mark.parametrize("limit", [L.EXACT_BYTES, -1])
def test_other_columns_pass_through_whatever_their_names(spark, limit):
    docs = spark.createDataFrame([(i, "a\nb", "mine", 1.5, "row") for i in range(3)], "doc_id bigint, text string, __uid string, `x.y` double, uid string")
    state = L.LineDedup(spark, min_docs=3, exact_bytes=limit).insert(docs)
    for r in state.dropped_lines(docs).collect():
        assert (r["text"], r["__uid"], r["x.y"], r["uid"], r["kept_text"]) == ("a\nb", "mine", 1.5, "row", "")


def test_shards_grow_with_the_state(spark):
    frame = lambda ids: spark.createDataFrame([(i, f"line {i // 2}") for i in ids], "doc_id bigint, text string")
    state = L.LineDedup(spark, min_docs=2, shard_keys=8).insert(frame([]))
    state.insert(frame(range(4)))
    assert state.shards == 1
    state.insert(frame(range(4, 200)))
    assert state.shards == 16 and state.filters.count() == 16
    assert {r.kept_text for r in state.dropped_lines(frame(range(200))).collect()} == {""}
    state.delete(frame(range(0, 200, 2)))
    assert "" not in {r.kept_text for r in state.dropped_lines(frame(range(200))).collect()}


def test_deletion_before_insertion_is_made_up_for(spark):
    frame = lambda n: spark.createDataFrame([(i, "a") for i in range(n)], "doc_id bigint, text string")
    state = L.LineDedup(spark, min_docs=3).delete(frame(2)).insert(frame(4))
    assert [r.n_docs for r in state.refs.collect()] == [2] and state.n_hot == 0


def test_deleting_documents_brings_lines_back(spark):
    frame = lambda ids: spark.createDataFrame([(i, f"shared\nown {i}") for i in ids], "doc_id bigint, text string")
    state = L.LineDedup(spark, min_docs=4).insert(frame(range(3)))
    kept = lambda: {r.kept_text for r in state.dropped_lines(frame([0])).collect()}
    assert kept() == {"shared\nown 0"}
    state.insert(frame([3, 4]))
    assert kept() == {"own 0"}
    state.delete(frame([3, 4]))
    assert kept() == {"shared\nown 0"}
    assert {r.n_docs for r in state.refs.collect()} == {1, 3}


def test_cuckoo_filter_inserts_deletes_and_grows():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (5000, 16), dtype=np.uint8)
    made = L.built(keys)
    assert made.might_contain(keys).all()
    others = rng.integers(0, 256, (20000, 16), dtype=np.uint8)
    assert made.might_contain(others).mean() < 0.01
    made.delete(keys[:2500])
    assert made.might_contain(keys[2500:]).all() and made.might_contain(keys[:2500]).mean() < 0.01
    again = L.CuckooFilter.load(made.buckets, made.dump())
    assert again.might_contain(keys[2500:]).all()
    assert not L.CuckooFilter(64).insert(keys)


def test_shards_agree_between_spark_and_numpy(spark):
    keys = [random.Random(i).randbytes(16) for i in range(200)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    from pyspark.sql import functions as F

    got = {bytes(r.key): r.s for r in df.select("key", L.shard_of(F.col("key"), 7).alias("s")).collect()}
    assert [got[k] for k in keys] == L.shards_of(L.as_array(keys), 7).tolist()
