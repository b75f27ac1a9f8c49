import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stranda.llm import quality as Q

SCHEMA = "doc_id bigint, text string, lang string, n_words string, lower int"


def plain_base(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in space:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in space for c in line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def plain_model(texts, least=Q.LEAST):
    """Modified Kneser-Ney over 5-grams of characters, with dictionaries of strings."""
    counts = {k: Counter() for k in range(1, 6)}
    for t in texts:
        s = Q.normal(Q.WORD.findall(t))
        counts[5].update(s[i - 5 : i] for i in range(5, len(s) + 1))
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, rest, total, held = {}, {}, {}, {}
    for k in range(1, 6):
        n = [0, *(sum(v == j for v in counts[k].values()) for j in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        cut[k] = [0, *(min(max(j - (j + 1) * y * n[j + 1] / n[j] if y is not None and n[j] else j / 2, 0.05), j) for j in (1, 2, 3))]
        by = defaultdict(list)
        for g, v in counts[k].items():
            by[g[:-1]].append(v)
        held[k] = {g: v - cut[k][min(v, 3)] for g, v in counts[k].items() if k < 5 or v >= least}
        total[k] = {h: sum(v) for h, v in by.items()}
        rest[k] = {h: 1 - sum(x - cut[k][min(x, 3)] for x in v if k < 5 or x >= least) / sum(v) for h, v in by.items()}

    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        h = g[:-1]
        if h not in total[k]:
            return prob(g[1:])
        return held[k].get(g, 0) / total[k][h] + rest[k][h] * prob(g[1:])

    return prob


def random_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


TEXTS = [None, "", " \n\t", "a", "a b c a b c a b c", "x # $ y\nx # $ y\n\nz", "Ünï ß £ 99 \x1c. |", "same line\nsame line\nsame line", "w " * 500, "L" * 70_000 + " a b"]


def test_base_rules_match_plain_ones():
    rng = random.Random(1)
    more = [random_text(rng, list("abcdef"), rng.randint(1, 90)).replace(" c ", "\n") for _ in range(40)]
    for t in TEXTS + more:
        assert Q.base_rules(t or "", Q.WORD.findall(t or "")) == plain_base(t)


def trained(spark, rows, **more):
    name = Q.QualityModel.train(spark.createDataFrame(rows, "text string, lang string"), **more).name
    return Q.model_of(name)


@pytest.mark.parametrize("least", [1, 2])
def test_model_matches_dictionaries_and_sums_to_one(spark, least):
    rng = random.Random(2)
    texts = [random_text(rng, ["there", "the", "then", "hat", "Ärger", "a,", "9", "\x1c日本"], 60) for _ in range(5)]
    model = trained(spark, [(t, "aa") for t in texts] + [("zz yy xx", None)], least=least)
    prob = plain_model(texts, least)
    some = [["the", "hat"], ["tha"], ["zebra", "Ä", "9,9"], ["q" * 300], texts[0].split(" ")]
    for words, got in zip(some, model.scores("aa", some), strict=True):
        s = Q.normal(words)
        want = -sum(math.log(prob(s[i - 5 : i])) for i in range(5, len(s) + 1)) / len(words)
        assert got == pytest.approx(want, rel=1e-4)
    # The characters that were seen, and one that stands for all others.
    known = {c for t in texts for c in Q.normal(Q.WORD.findall(t))}
    assert sum(prob(" the"[-4:] + c) for c in [*known, "q"]) == pytest.approx(1)


def test_words_in_another_order_cost_more(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    follows = {w: rng.sample(words, 3) for w in words}

    def text():
        out = [rng.choice(words)]
        while len(out) < 120:
            out.append(rng.choice(follows[out[-1]]))
        return out

    texts = [text() for _ in range(200)]
    model = trained(spark, [(" ".join(t), "aa") for t in texts])
    mixed = [rng.sample(t, len(t)) for t in texts[:50]]
    assert all(b > 1.1 * a for a, b in zip(model.scores("aa", texts[:50]), model.scores("aa", mixed), strict=True))


def test_what_is_gathered_grows_with_the_corpus(spark):
    rng = random.Random(6)
    rows = [(random_text(rng, ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)], 100), "aa") for _ in range(40)]
    assert len(trained(spark, rows).keys) > 3 * len(trained(spark, rows[:4]).keys)


def test_scores_do_not_depend_on_the_batch(spark, monkeypatch):
    rows = [("alpha beta gamma delta", "aa"), ("beta beta", "aa")]
    model = trained(spark, rows)
    texts = [t.split() for t in ("alpha beta", "gamma delta beta", "a b c d e f", "alpha alpha")]
    whole = model.scores("aa", texts)
    monkeypatch.setattr(Q, "CHARS", 1)
    assert model.scores("aa", texts) == pytest.approx(whole) and [model.scores("aa", [t])[0] for t in texts] == pytest.approx(whole)


def test_repeated_windows_of_a_very_long_text():
    words = [f"w{i}" for i in range(1 << 21)] + ["w0", "w1", "w2"]
    assert Q.repeated_words(words) == 6


def frame(spark, rng):
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, random_text(rng, words, 120), "aa" if i % 2 else None, "clash", 1) for i in range(60)]
    rows += [(100 + i, t, "aa", "clash", 1) for i, t in enumerate(TEXTS)]
    rows.append((200, " ".join("".join(rng.choice("zqxjkvwß#%") for _ in range(7)) for _ in range(120)), "aa", "clash", 1))
    rows += [(None, rows[0][1], None, None, None)] * 2
    return spark.createDataFrame(rows, SCHEMA)


def test_query_rows_and_filter_agree(spark):
    docs = frame(spark, random.Random(3))
    model = Q.QualityModel.train(docs)
    scored = model.scored(docs, keep=["doc_id", "lang", "text"])
    rows = model.find_bands(scored).verdicts(scored).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(r.text)
        assert r.kept == (not r.base_failed and r.lower <= r.log_perplexity <= r.upper)
    odd = next(r for r in rows if r.doc_id == 200)
    assert not odd.base_failed and not odd.kept
    assert sum(r.kept for r in rows) >= 60
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    odd_names = docs.withColumn("__row", docs.doc_id).withColumn("__lang", docs.lang).withColumn("x.y", docs.doc_id)
    assert Q.kept(odd_names).columns == odd_names.columns
    got = Q.kept(docs)
    assert got.columns == docs.columns
    assert sorted(map(key, got.collect())) == sorted(key(r) for r in rows if r.kept)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert Q.kept(none).count() == 0
