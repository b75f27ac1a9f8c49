import math
import random
import zlib
from collections import defaultdict

import pytest

from stranda.llm import langid as L

SCHEMA = "doc_id bigint, text string, lang string, score int, lang_pred string"


def plain_bits(training, text):
    """Code lengths by language from plain nested counts, one byte at a time."""
    out = {}
    for lang, texts in training.items():
        follow = defaultdict(lambda: defaultdict(int))
        for t in texts:
            for w in L.words_of(t):
                data = b" " + w.lower().encode()
                for i in range(1, len(data)):
                    for k in range(min(i, L.ORDER) + 1):
                        follow[data[i - k : i]][data[i]] += 1
        bits = 0.0
        for w in L.words_of(text):
            data = b" " + w.lower().encode()
            for i in range(1, len(data)):
                for k in range(min(i, L.ORDER), -1, -1):
                    seen = follow.get(data[i - k : i])
                    if not seen:
                        continue
                    total, kinds = sum(seen.values()), len(seen)
                    if data[i] in seen:
                        bits -= math.log2(seen[data[i]] / (total + kinds))
                        break
                    bits -= math.log2(kinds / (total + kinds))
                else:
                    bits += 8
        out[lang] = bits
    return out


def corpus():
    rng = random.Random(4)
    parts = {"xx": ["ka", "lo", "mi", "ña"], "yy": ["ster", "ung", "ach", "über"], "zz": ["kal", "ung", "mist", "o"]}
    rows = []
    for i in range(90):
        lang = ("xx", "yy", "zz")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30)).title(), lang, 1, "clash"))
    return rows


def test_bits_match_plain_counts_and_held_out_rows_are_right(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    trees = L.learn(docs)
    training = defaultdict(list)
    for i, t, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            training[lang].append(t)
    assert trees.langs == ["xx", "yy", "zz"]
    scorer = L.Scorer(trees)
    for text in [rows[1][1], "stermika", "Ω qqq", "o" * 500]:
        want = plain_bits(training, text)
        got = scorer.lengths(L.words_of(text))
        assert got == pytest.approx([want[c] for c in trees.langs])
        lang, score = scorer.predict(text)
        assert want[lang] == pytest.approx(min(want.values()))
        assert score == pytest.approx(L.score_of(list(want.values()), sum(map(len, L.words_of(text)))))
    found = {r.doc_id: r for r in L.predictions(docs, trees).withColumn("held", L.held_out()).collect()}
    assert all(found[i].held == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(90))
    assert sum(found[i].lang_pred == lang for i, _, lang, *_ in rows) >= 88


def test_texts_without_letters_and_nulls(spark):
    odd = [(900, None, "xx", 1, ""), (901, "", "xx", 1, ""), (902, "12 ² _ !", "yy", 1, ""), (None, "kamika", None, None, None), (903, "kamika " * 60_000, None, 1, "")]
    docs = spark.createDataFrame(corpus() + odd, SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predictions(docs, L.learn(docs)).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[None][0] == got[903][0] == "xx"
    kept = L.kept(docs)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None, 1, "")], SCHEMA)
    assert [(r.lang_pred, r.score) for r in L.predictions(docs, L.learn(docs)).collect()] == [("und", 0.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert L.kept(none).count() == 0


def test_scorer_forgets_words_without_changing_scores(spark):
    trees = L.ContextTrees([("a", b"x", 3), ("b", b"y", 2), ("a", b" x", 1)])
    wide, narrow = L.Scorer(trees), L.Scorer(trees, most=2)
    for words in (["x", "y"], ["xy", "yx"], ["x", "y", "xx", "yy"], ["x"]):
        assert narrow.lengths(words) == pytest.approx(wide.lengths(words))


def test_texts_in_no_learned_language_are_rejected(spark):
    rng = random.Random(6)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60))
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心",
        noise,
    ]
    docs = spark.createDataFrame(corpus() + [(800 + k, t, None, 1, "") for k, t in enumerate(foreign)], SCHEMA)
    before = L.predictions(docs, L.learn(docs)).filter("doc_id >= 800 and score >= 0.5").count()
    assert before >= 3  # the share of the likelihood alone lets them pass
    kept = {r.doc_id for r in L.kept(docs).collect()}
    assert not kept & set(range(800, 805)) and len(kept) >= 88
