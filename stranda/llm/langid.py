"""Language ID by partial matching: byte context trees of variable order, one for each language, score exact code lengths.

A text is read as its runs of letters, lower-cased, each with a space before it, in UTF-8. A language's tree holds how often each byte
followed each context of up to ORDER bytes; contexts don't reach over the space. A byte costs its frequency in the longest context
that saw it, and an escape for each longer context that was seen without it (method C: a context seen T times with D different
bytes gives a byte seen n times n / (T + D), and an escape D / (T + D)); a byte that no context saw costs eight bits more. Statistics
are frozen: scoring doesn't change them. The language with the least bits for the whole text wins, ties go to the first in order.

Trees are learned from a bounded sample of labelled rows, about ``sample_docs`` a language (by the hash of doc_id), so they are small
enough to be broadcast; every row is scored, over its whole text.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or if nothing could be learned; a null doc_id
is neither held out nor learned from; repeated rows count each; tables without rows give tables without rows; other columns
pass through, but for one that has an appended column's name, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stranda.llm import common

ORDER = 4
SAMPLE_DOCS = 600
#: The score is the winner's share of the likelihood of this many bytes, at the text's mean cost.
SCORE_BYTES = 24
#: In filters, texts with a lower score are rejected.
MIN_SCORE = 0.5
#: In filters, texts are rejected whose bits a letter exceed their language's median by more than WIDTH robust deviations, of at least FLOOR medians.
WIDTH, FLOOR = 10.0, 0.15
#: Steps of the histogram of bits a letter from which medians are read.
STEP = 1 / 128
LETTERS = re.compile(r"[^\W\d_]+")
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
COST = T.StructField("__bits", T.DoubleType())


def word_grams(word: str) -> Iterator[bytes]:
    """Each byte after the space with its longest context."""
    data = b" " + word.lower().encode()
    for i in range(1, len(data)):
        yield data[max(0, i - ORDER) : i + 1]


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text)


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def count_contexts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often a byte, the gram's last, followed the context before it, for every order."""

    def tally(words: dict[str, Counter]) -> list:
        out = [[], [], []]
        for code, counts in words.items():
            seen: Counter = Counter()
            for word, n in counts.items():
                for gram in word_grams(word):
                    for k in range(len(gram)):
                        seen[gram[k:]] += n
            out[0] += [code] * len(seen)
            out[1] += seen.keys()
            out[2] += seen.values()
        words.clear()
        return out

    def run(parts: Iterator[list[pa.Array]]) -> Iterator[list]:
        words: dict[str, Counter] = defaultdict(Counter)
        for langs, column in parts:
            for code, t in zip(langs.to_pylist(), common.texts(column), strict=True):
                words[code].update(words_of(t))
            if sum(map(len, words.values())) > 100_000:
                yield tally(words)
        yield tally(words)

    return common.emit(docs, "lang string, gram binary, n bigint", run, [lang, text]).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Costs in bits, for all languages at once, of grams (a byte after its context) and of escapes."""

    def __init__(self, counts: list[tuple[str, bytes, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: k for k, lang in enumerate(self.langs)}
        n = len(self.langs)
        seen: dict[bytes, np.ndarray] = {}
        total: dict[bytes, np.ndarray] = {}
        kinds: dict[bytes, np.ndarray] = {}
        for lang, gram, count in counts:
            k, context = at[lang], gram[:-1]
            for table, key, value in ((seen, gram, count), (total, context, count), (kinds, context, 1)):
                if key not in table:
                    table[key] = np.zeros(n)
                table[key][k] += value
        rows: list[np.ndarray] = [np.full(n, 8.0)]
        self.escape: dict[bytes, int] = {}
        self.gram: dict[bytes, int] = {}
        for context in total:
            t, d = total[context], kinds[context]
            self.escape[context] = len(rows)
            rows.append(np.where(t > 0, -np.log2(np.maximum(d, 1) / np.maximum(t + d, 1)), 0.0))
        for gram in sorted(seen, key=len):
            context, c = gram[:-1], seen[gram]
            t, d = total[context], kinds[context]
            shorter = rows[self.gram[gram[1:]]] if len(gram) > 1 else rows[0]
            direct = -np.log2(np.maximum(c, 1) / np.maximum(t + d, 1))
            self.gram[gram] = len(rows)
            rows.append(np.where(c > 0, direct, rows[self.escape[context]] + shorter))
        self.rows = np.array(rows).reshape(-1, n) if n else np.zeros((1, 0))

    def cost_rows(self, word: str) -> list[int]:
        """The rows that make up a word's cost."""
        out, gram_at, escape_at = [], self.gram, self.escape
        for gram in word_grams(word):
            while gram not in gram_at:
                context = gram[:-1]
                if context in escape_at:
                    out.append(escape_at[context])
                if not context:
                    out.append(0)
                    break
                gram = gram[1:]
            else:
                out.append(gram_at[gram])
        return out

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language."""
        parts = [self.cost_rows(w) for w in words]
        sizes = np.array([len(p) for p in parts])
        flat = np.fromiter((r for p in parts for r in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        return np.add.reduceat(self.rows[flat], ends - sizes, axis=0) if len(flat) else np.zeros((len(words), len(self.langs)))


class Scorer:
    """Scores texts, with a bounded memory of words."""

    def __init__(self, trees: ContextTrees, most: int = 300_000):
        self.trees, self.most = trees, most
        self.at: dict[str, int] = {}
        self.bits = np.zeros((most, len(trees.langs)))

    def lengths(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.at})
        if len(self.at) + len(new) > self.most:
            self.at.clear()
            new = list(set(words))
            if len(new) > self.most:  # a text of so many different words is scored by itself
                counts = Counter(words)
                return sum(np.array([counts[w] for w in new[i : i + 10_000]]) @ self.trees.code_lengths(new[i : i + 10_000]) for i in range(0, len(new), 10_000))
        if new:
            start = len(self.at)
            self.at.update(zip(new, range(start, start + len(new)), strict=True))
            self.bits[start : start + len(new)] = self.trees.code_lengths(new)
        return self.bits[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        return self.measure(text)[:2]

    def measure(self, text: str) -> tuple[str, float, float | None]:
        """The language, the score, and the bits a letter under the language's tree."""
        words = words_of(text)
        if not self.trees.langs or not has_letter(words):
            return "und", 0.0, None
        bits = self.lengths(words)
        size = sum(len(w) for w in words)
        weights = np.exp2(-(bits - bits.min()) * min(1.0, SCORE_BYTES / size))
        best = int(bits.argmin())
        return self.trees.langs[best], float(weights[best] / weights.sum()), float(bits[best]) / size


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> ContextTrees:
    """Trees from the labelled rows that aren't held out: about ``sample_docs`` of each language, chosen by the hash of doc_id."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return ContextTrees([])
    share = F.create_map(*[x for code, n in sizes.items() for x in (F.lit(code), F.lit(min(1.0, sample_docs / n)))])[F.col("lang")]
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    got = count_contexts(chosen).toArrow()
    return ContextTrees(list(zip(got["lang"].to_pylist(), got["gram"].to_pylist(), got["n"].to_pylist(), strict=True)))


def predictions(docs: DataFrame, trees: ContextTrees, text: str = "text", keep: list[str] | None = None, cost: bool = False) -> DataFrame:
    """Rows with lang_pred and score appended, and with ``cost`` the bits a letter as __bits."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    fields = [*FIELDS, COST] if cost else FIELDS

    def run(scorer, column):
        found = [scorer.measure(t) for t in common.texts(column)]
        return [[f[k] for f in found] for k in range(len(fields))]

    return common.add_columns(docs, fields, run, [text], lambda: Scorer(shared.value), keep)


def weighted_median(pairs: list[tuple[int, int]]) -> int:
    half, seen = sum(n for _, n in pairs) / 2, 0
    for value, n in sorted(pairs):
        seen += n
        if seen >= half:
            return value
    return 0


def bounds(found: DataFrame, width: float = WIDTH, floor: float = FLOOR) -> dict[str, float]:
    """By language, the most bits a letter that its texts may cost: from all rows (lang_pred, __bits, __lang, __held) whose label agrees.

    Held-out rows tell it, as nothing was learned from them; if a language has none, its other rows do. Only histograms are gathered.
    """
    bins = found.filter(F.col("lang_pred") == F.col("__lang")).groupBy("lang_pred", "__held", F.round(F.col("__bits") / STEP).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    by: dict[str, dict[bool, list]] = defaultdict(lambda: defaultdict(list))
    for r in bins.collect():
        by[r.lang_pred][r["__held"]].append((r.bin, r.n))
    out = {}
    for code, rows in by.items():
        pairs = rows[True] or rows[False]
        mid = weighted_median(pairs)
        sigma = max(floor * mid, 1.4826 * weighted_median([(abs(b - mid), n) for b, n in pairs]))
        out[code] = (mid + width * sigma) * STEP
    return out


def kept(docs: DataFrame, min_score: float = MIN_SCORE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows whose language is found with some certainty and that cost no more bits than its texts do, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text"), F.col(lang).alias("__lang"), held_out(doc_id).alias("__held"))
    found = predictions(rows, learn(docs, text=text, lang=lang, doc_id=doc_id), "__text", ["__row", "__lang", "__held"], cost=True)
    found = common.save(found, "languages")
    most = bounds(found)
    if not most:
        return docs.limit(0)
    limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("lang_pred")]
    # A language of which no labelled row was recognised has no bound.
    fits = F.coalesce(F.col("__bits") <= limit, F.lit(True))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score) & fits).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = predictions(docs, learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def score_of(bits: list[float], size: int) -> float:
    """The score, plainly: for tests."""
    low = min(bits)
    weights = [2 ** (-(b - low) * min(1.0, SCORE_BYTES / size)) for b in bits]
    return max(weights) / math.fsum(weights)
