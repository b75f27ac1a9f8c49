"""Quality rules: n-gram perplexity under a modified Kneser-Ney model, with an upper and a lower band for each language.

Words are runs of anything but ASCII white space. The model is over the characters of a text's words, lower-cased, with one space between words;
its 5-grams reach over words, so it sees which words follow each other, and every code point is a symbol of its own. Spark counts the 5-grams
of all documents by language, each different text once; shorter grams count the different grams that they end. Modified Kneser-Ney weights are kept in one array for all
languages, sorted by a 64-bit hash of language, order and gram (with 2**32 keys, one lookup in four thousand million is wrong): it grows with
the corpus, is written in parts, handed out by Spark and memory-mapped by the scorers. 5-grams seen under LEAST times are left out of
it (their weight goes to shorter grams), which is what keeps it small on large corpora; that is the one pruning, and a parameter.

A document fails the base rules with under ``min_words`` words, or if words in repeated 3-word windows make up over
``max_repeat`` percent. Otherwise its log perplexity, of a word, must lie within its language's band: median plus and minus ``width`` robust
standard deviations (1.4826 times the median absolute deviation, at least ``floor``) over all documents of the language that pass
the base rules and have MIN_WORDS words (over those with fewer, if none has). A mean over few words strays further, so for a text under REFERENCE
words the band is wider by the square root of what it lacks.

Defined results: a null or empty text has no words and fails; a null language is a language of its own; repeated rows count each;
tables without rows give tables without rows; other columns pass through, but for one that has an appended column's name, which is replaced.
The driver holds one row for each language (its band).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stranda.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT = 50, 50
#: Robust standard deviations to either side, and the least that counts as one, in nats of log perplexity.
WIDTH, FLOOR = 3.5, 0.1
#: Words from which on a band has its plain width.
REFERENCE = 200
#: Steps of the histogram of log perplexities from which medians are read.
STEP = 1 / 256

ORDER = 5
#: 5-grams seen less often are left to shorter grams.
LEAST = 2
#: Different 5-grams that a task sums before it sends them, and characters that are scored at once.
HELD, CHARS = 300_000, 500_000
BASE_OF_HASH = np.uint64(0x9E3779B97F4A7C15)

BASE = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType())]
SCORE = [T.StructField("log_perplexity", T.DoubleType())]
GRAM, CONTEXT, UNSEEN = 0, 1, 2


def normal(words: list[str]) -> str:
    """What is modelled of a text: spaces as the context of its first characters, then its words."""
    return " " * (ORDER - 1) + " ".join(words).lower()


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of normalised texts, the places of all characters but the leading spaces, and how many of these each text has."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) - (ORDER - 1)
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    return points, np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), sizes


def rolled(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each place's 5-gram, for telling grams of one batch apart."""
    out = np.zeros(len(at), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        out *= BASE_OF_HASH
        out += points[at - k]
    return out


def different(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different 5-grams as rows of code points, and which one stands at each place."""
    codes, found = pd.factorize(rolled(points, at))
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = at[::-1]
    return points[first[:, None] + np.arange(1 - ORDER, 1)], codes


def as_strings(grams: np.ndarray) -> list[str]:
    width = grams.shape[1]
    text = np.ascontiguousarray(grams, np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + width] for i in range(0, len(text), width)]


def distinct_texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(text, lang) with each text of a language once, so that no text is learned by heart from its copies.

    Only texts that repeat are moved; which these are is told by hash and length.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang")).filter("text is not null")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("size", F.length("text"))
    keys = ["h", "size", "lang"]
    again = common.save(rows.groupBy(keys).agg(F.count("*").alias("n")).filter("n > 1").select(keys), "repeated-texts")
    once = rows.join(again, keys, "left_anti").select("text", "lang")
    return once.unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys).select("text", "lang"))


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all documents; summed within a task before it is sent."""

    def run(parts: Iterator[list[pa.Array]]) -> Iterator[list]:
        held: dict[str, list] = {}

        def summed(code: str) -> None:
            grams = np.concatenate([g for g, _ in held[code]])
            n = np.concatenate([n for _, n in held[code]])
            different_, at = different(grams.ravel(), np.arange(len(grams)) * ORDER + ORDER - 1)
            held[code] = [(different_, np.bincount(at, n).astype(np.int64))]

        def sent() -> Iterator[list]:
            for code in held:
                summed(code)
                grams, n = held[code][0]
                for k in range(0, len(n), 1 << 16):
                    yield [[code] * len(n[k : k + (1 << 16)]), as_strings(grams[k : k + (1 << 16)]), n[k : k + (1 << 16)]]
            held.clear()

        size = 0
        for langs, column in parts:
            by: dict[str, list[str]] = {}
            for code, t in zip(langs.to_pylist(), common.texts(column), strict=True):
                if words := WORD.findall(t):
                    by.setdefault(code or "", []).append(normal(words))
            for code, texts in by.items():
                points, at, _ = stream(texts)
                grams, codes = different(points, at)
                held.setdefault(code, []).append((grams, np.bincount(codes, minlength=len(grams))))
                size += len(grams)
            if size > HELD:
                for code in held:
                    summed(code)
                size = sum(len(n) for parts_ in held.values() for _, n in parts_)
                if size > HELD // 2:
                    yield from sent()
                    size = 0
        yield from sent()

    rows = common.emit(distinct_texts(docs, text, lang), "lang string, gram string, n bigint", run, ["lang", "text"])
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(kind, lang, level, gram, a, b) of the model: for grams a = discounted count; for contexts a = their total, b = the weight of shorter
    grams; and for each language, under UNSEEN, the probability of a character never seen."""
    level = counts.select("lang", F.lit(ORDER).alias("level"), "gram", F.col("n").alias("a"))
    grams = level
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("a")).select("lang", F.lit(k).alias("level"), "gram", "a")
        level = common.save(level, "grams")
        grams = grams.unionByName(level)
    n1, n2, n3, n4 = (F.count_if(F.col("a") == k).cast("double") for k in (1, 2, 3, 4))
    seen = grams.groupBy("lang", "level").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"), F.count("*").alias("kinds"))
    y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
    cut = [F.least(F.greatest(F.coalesce(F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")), F.lit(k / 2)), F.lit(0.05)), F.lit(float(k))) for k in (1, 2, 3)]
    cuts = common.save(seen.select("lang", "level", *[c.alias(f"d{k + 1}") for k, c in enumerate(cut)], "kinds"), "discounts")
    kept = (F.col("level") < ORDER) | (F.col("a") >= least)
    contexts = grams.groupBy("lang", "level", F.expr("substring(gram, 1, level - 1)").alias("gram")).agg(
        F.sum("a").cast("double").alias("total"),
        F.coalesce(F.sum(F.when(kept, F.col("a"))), F.lit(0)).cast("double").alias("held"),
        *[F.count_if(kept & (F.col("a") == k if k < 3 else F.col("a") >= 3)).alias(f"k{k}") for k in (1, 2, 3)],
    )
    contexts = contexts.join(cuts, ["lang", "level"])
    rest = 1 - (F.col("held") - F.col("d1") * F.col("k1") - F.col("d2") * F.col("k2") - F.col("d3") * F.col("k3")) / F.col("total")
    contexts = contexts.select("lang", "level", "gram", "total", rest.alias("rest"), "kinds")
    cut_of = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = grams.filter(kept).join(cuts, ["lang", "level"]).select(F.lit(GRAM).alias("kind"), "lang", "level", "gram", (F.col("a") - cut_of).cast("float").alias("a"), F.lit(0.0).cast("float").alias("b"))
    longer = contexts.filter((F.col("level") < ORDER) | (F.col("rest") < 1)).select(F.lit(CONTEXT).alias("kind"), "lang", "level", "gram", F.col("total").cast("float").alias("a"), F.col("rest").cast("float").alias("b"))
    unseen = contexts.filter("level = 1").select(F.lit(UNSEEN).alias("kind"), "lang", "level", "gram", (1 / (F.col("kinds") + 1)).cast("float").alias("a"), F.lit(0.0).cast("float").alias("b"))
    return own.unionByName(longer).unionByName(unseen)


def keys_of(kind: int, level: int, lang: str, grams: np.ndarray) -> np.ndarray:
    """64-bit keys of grams, rows of code points, within the one table."""
    seed = np.uint64(xxhash.xxh64_intdigest(f"{kind} {level} {lang}".encode()))
    out = np.full(len(grams), seed)
    for k in range(grams.shape[1]):
        out = (out ^ grams[:, k].astype(np.uint64)) * BASE_OF_HASH
        out ^= out >> np.uint64(29)
    return out


def write_model(rows: DataFrame) -> str:
    """Sorts the weights by key and hands them out as one file; its name. The driver holds one part of them at a time."""
    spark = rows.sparkSession

    def keyed(parts):
        for kinds, langs, levels, grams, a, b in parts:
            frame = pd.DataFrame({"kind": kinds.to_pylist(), "lang": langs.to_pylist(), "level": levels.to_pylist(), "gram": grams.to_pylist()})
            key = np.zeros(len(frame), np.uint64)
            for (kind, lang, level), group in frame.groupby(["kind", "lang", "level"]):
                texts = group["gram"].tolist()
                points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1) if texts[0] else np.zeros((len(texts), 0), np.uint32)
                key[group.index.to_numpy()] = keys_of(kind, level, lang, points)
            # As signed numbers in the order of the unsigned ones.
            yield [(key ^ np.uint64(1 << 63)).view(np.int64), a, b]

    def packed(parts):
        for key, a, b in parts:
            values = key.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
            yield [[len(key)], [values.tobytes()], [a.to_numpy(zero_copy_only=False).astype(np.float32).tobytes()], [b.to_numpy(zero_copy_only=False).astype(np.float32).tobytes()]]

    table = common.emit(rows, "key bigint, a float, b float", keyed, ["kind", "lang", "level", "gram", "a", "b"], rows=1 << 16)
    table = common.emit(table.repartitionByRange("key").sortWithinPartitions("key"), "n bigint, keys binary, a binary, b binary", packed, ["key", "a", "b"], rows=1 << 16)
    table = common.save(table.select(F.monotonically_increasing_id().alias("at"), "*"), "perplexity-model")
    n = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    columns = ((bytes(r[0]) for r in table.orderBy("at").select(c).toLocalIterator()) for c in ("keys", "a", "b"))
    return common.put_parts(spark, "perplexity", chain([np.int64(n).tobytes()], *columns))


class Model:
    """The weights of all languages, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view(np.int64)[0])
        self.keys, self.a, self.b = data[8 : 8 + 8 * n].view(np.uint64), data[8 + 8 * n : 8 + 12 * n].view(np.float32), data[8 + 12 * n : 8 + 16 * n].view(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and whether they are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        order = np.argsort(keys)
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def log_probs(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """The log probability of each 5-gram's last character after the four before it."""
        at, known = self.find(keys_of(UNSEEN, 1, lang, grams[:1, :0]))
        p = np.full(len(grams), float(self.a[at[0]]) if known[0] else 1e-6)
        for k in range(1, ORDER + 1):
            own, there = self.find(keys_of(GRAM, k, lang, grams[:, ORDER - k :]))
            if k == 1:
                above, known = self.find(keys_of(CONTEXT, 1, lang, grams[:1, :0]))
                above, known = np.repeat(above, len(grams)), np.repeat(known, len(grams))
            else:
                above, known = self.find(keys_of(CONTEXT, k, lang, grams[:, ORDER - k : ORDER - 1]))
            mass = np.where(there, self.a[own], 0) / np.where(known, self.a[above], 1)
            p = np.where(known, mass + np.where(known, self.b[above], 1) * p, p)
        return np.log(p)

    def scores(self, lang: str, texts: list[list[str]]) -> list[float]:
        """Log perplexities (of a word) of texts, each a list of words and none empty."""
        out: list[float] = []
        some: list[str] = []
        size = 0
        for k, words in enumerate(texts):
            some.append(normal(words))
            size += len(some[-1])
            if size > CHARS or k == len(texts) - 1:
                points, at, sizes = stream(some)
                grams, codes = different(points, at)
                logs = self.log_probs(lang, grams)[codes]
                out += (-np.add.reduceat(logs, np.cumsum(sizes) - sizes) / np.array([len(w) for w in texts[len(out) : k + 1]])).tolist()
                some, size = [], 0
        return out


_models: dict[str, Model] = {}


def model_of(name: str) -> Model:
    """A worker keeps the last model that it mapped."""
    if name not in _models:
        _models.clear()
        _models[name] = Model(SparkFiles.get(name))
    return _models[name]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map({}.setdefault, words, count()), np.int64, n)  # a word's first place
    if n < 1 << 21:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def base_rules(text: str, words: list[str], min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> tuple:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n, again = len(words), repeated_words(words)
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, n < min_words or 100 * again > max_repeat * n)


class QualityModel:
    """The model's file, and bands by language."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.bands: dict[str, tuple[float, float]] = {}

    @classmethod
    def train(cls, docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> QualityModel:
        counts = common.save(count_grams(docs, text, lang), "gram-counts")
        return cls(docs.sparkSession, write_model(common.save(weights(counts, least), "gram-weights")))

    def scored(self, docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
        """Rows with the base rules' columns and log_perplexity appended (null for texts without words)."""
        name = self.name

        def run(model, langs, column):
            whole = common.texts(column)
            words = [WORD.findall(t) for t in whole]
            scores: list[float | None] = [None] * len(whole)
            by: dict[str, list[int]] = {}
            for i, code in enumerate(langs.to_pylist()):
                if words[i]:
                    by.setdefault(code or "", []).append(i)
            for code, rows in by.items():
                for i, score in zip(rows, model.scores(code, [words[i] for i in rows]), strict=True):
                    scores[i] = score
            out = [(*base_rules(t, w, min_words, max_repeat), s) for t, w, s in zip(whole, words, scores, strict=True)]
            return [list(c) for c in zip(*out, strict=True)] or [[] for _ in range(7)]

        return common.add_columns(docs, BASE + SCORE, run, [lang, text], lambda: model_of(name), keep)

    def find_bands(self, scored: DataFrame, lang: str = "lang", floor: float = FLOOR) -> QualityModel:
        """Sets the bands (median and deviation) from scored rows; only histograms by language are gathered."""
        bins = (
            scored.filter(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
            .groupBy(F.coalesce(lang, F.lit("")).alias("code"), (F.col("n_words") >= MIN_WORDS).alias("long"), F.round(F.col("log_perplexity") / STEP).cast("int").alias("bin"))
            .agg(F.count("*").alias("n"))
        )
        by: dict[str, dict[bool, list]] = {}
        for r in bins.collect():
            by.setdefault(r.code, {}).setdefault(r.long, []).append((r.bin, r.n))
        self.bands = {}
        for code, found in by.items():
            pairs = found.get(True) or found[False]
            mid = weighted_median(pairs)
            self.bands[code] = mid * STEP, max(floor, 1.4826 * weighted_median([(abs(b - mid), n) for b, n in pairs]) * STEP)
        return self

    def verdicts(self, scored: DataFrame, lang: str = "lang", width: float = WIDTH) -> DataFrame:
        """Rows with ``lower``, ``upper`` and ``kept`` appended; the bands are one row a language."""
        bands = self.spark.createDataFrame([(c, *b) for c, b in self.bands.items()], "__code string, __mid double, __sigma double")
        joined = scored.join(bands, F.coalesce(F.col(lang), F.lit("")) == F.col("__code"), "left")
        reach = width * F.col("__sigma") * F.sqrt(F.greatest(F.lit(1.0), REFERENCE / F.greatest(F.col("n_words"), F.lit(1))))
        joined = joined.withColumn("lower", F.col("__mid") - reach).withColumn("upper", F.col("__mid") + reach).drop("__code", "__mid", "__sigma")
        return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False)))


def weighted_median(pairs: list[tuple[int, int]]) -> int:
    half, seen = sum(n for _, n in pairs) / 2, 0
    for value, n in sorted(pairs):
        seen += n
        if seen >= half:
            return value
    return 0


def kept(docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows that pass, with their own columns. Each text is scored once; rows and scores are written, and read again with the bands."""
    model = QualityModel.train(docs, text, lang)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    scored = common.save(model.scored(rows, keep=["row", "lang"], min_words=min_words, max_repeat=max_repeat), "quality-scores")
    return model.find_bands(scored).verdicts(scored).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = QualityModel.train(docs)
    scored = common.save(model.scored(docs, keep=["doc_id", "lang"]), "quality-scores")
    model.find_bands(scored)
    out = model.verdicts(scored)
    return out.select("doc_id", *[f.name for f in BASE], "kept", F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("lower_perplexity"), F.exp("upper").alias("upper_perplexity"))
