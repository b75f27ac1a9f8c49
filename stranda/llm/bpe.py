"""BPE encoding and decoding by a minimal acyclic transducer.

Spark counts the pre-tokens of all texts; the most frequent (whole steps of a histogram of counts, LEXICON_WORDS at most) are compiled, with
the ids that they encode to, into an automaton in which words share prefixes and suffixes: each arc carries a number, the numbers along a word's path add up to the
word's place in the lexicon, and the place gives its ids. The automaton is one flat file that Spark hands to each executor, where the workers
memory-map it. Pre-tokens that it doesn't hold are merged exactly, pair by pair in order of rank.

The results are those of the tokenizers library without truncation, padding or added special tokens; a special token's string within a text
becomes its id, as there. Decoding goes from ids to bytes to text, special tokens included.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows count each; tables without rows
give tables without rows; other columns pass through, but for one that has an appended column's name, which is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stranda.llm import common, encoders

LEXICON_WORDS, STEPS = 1 << 16, 32
#: Longer pre-tokens aren't put in the lexicon; they are merged like others that it lacks.
LONGEST = 48
#: Distinct words that are summed in a task at once.
COUNTED = 400_000
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


#: A merge's rank and the id that it makes as one number.
NONE, LOW = 1 << 62, (1 << 24) - 1


SLOTS = 18
MASK = (1 << SLOTS) - 1


def slots(pairs: np.ndarray) -> np.ndarray:
    """Places of pairs of ids in a hash table."""
    return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A byte-level BPE vocabulary read from its file: exact merging, and ids to bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, vocab = byte_letters(), data["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.token = {i: as_bytes(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.joined: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.joined.setdefault((vocab[a], vocab[b]), k << 24 | vocab[a + b])

        # For whole batches: the same pairs in an open hash table, single bytes' ids, and each id as text and as bytes.
        pairs = np.array([a << 32 | b for a, b in self.joined], np.int64)
        self.slot, self.value = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, NONE, np.int64)
        values = np.fromiter(self.joined.values(), np.int64, len(pairs))
        at = slots(pairs)
        while len(pairs):
            free = self.slot[at] < 0
            self.slot[at[free]] = pairs[free]
            mine = self.slot[at] == pairs
            self.value[at[mine]] = values[mine]
            pairs, values, at = pairs[~mine], values[~mine], (at[~mine] + 1) & MASK
        self.single = np.array(self.of_byte, np.int64)
        tokens = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self.bytes = pa.array(tokens, pa.large_binary())
        self.texts = pa.array([f"{i}," for i in range(len(tokens))], pa.large_string()).cast(pa.large_binary())

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of ids what ``joined`` holds, or NONE."""
        pairs = first << 32 | second
        at = slots(pairs)
        out = self.value[at]
        held = self.slot[at]
        open_ = np.flatnonzero((held != pairs) & (held >= 0))
        out[held != pairs] = NONE
        while len(open_):
            at[open_] = (at[open_] + 1) & MASK
            held = self.slot[at[open_]]
            same = held == pairs[open_]
            out[open_[same]] = self.value[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out

    def merge_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pre-tokens (large strings, none empty) one after the other, and where each one's begin and end.

        All words are merged together: in each round every word joins its best pair, the first if there are several.
        """
        offsets, data = raw(words)
        sizes = np.diff(offsets)
        ids = self.single[data[offsets[0] : offsets[-1]]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(ids), NONE, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        done_word, done_ids = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(rank, starts)
            ended = best == NONE
            if ended.any():
                mask = np.repeat(ended, sizes)
                done_word.append(word[mask])
                done_ids.append(ids[mask])
                ids, word, rank = ids[~mask], word[~mask], rank[~mask]
                best, sizes = best[~ended], sizes[~ended]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            ids[at] = rank[at] & LOW
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one id goes before each later place
            ids, word, rank = ids[keep], word[keep], rank[keep]
            left, right = at[(at > 0) & (word[at] == word[at - 1])], at + 1 < len(ids)
            right[right] = word[at[right] + 1] == word[at[right]]
            rank[at[~right]] = NONE
            rank[at[right]] = self.ranks(ids[at[right]], ids[at[right] + 1])
            rank[left - 1] = self.ranks(ids[left - 1], ids[left])
        every, made = np.concatenate([np.zeros(0, np.int64), *done_word]), np.concatenate([np.zeros(0, np.int64), *done_ids])
        order = np.argsort(every, kind="stable")
        return made[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(words)))])

    def merge(self, word: bytes) -> list[int]:
        """A pre-token's ids."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.joined.get
        found = [get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best & LOW]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a heap of pairs over a linked list."""
        n, joined = len(ids), self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(joined[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in joined]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made & LOW, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in joined:
                    heapq.heappush(heap, (joined[p], x, *p))
        return [i for i in ids if i >= 0]


class Lexicon:
    """The transducer's file: arcs by state, sorted by label; a word's place is the sum of its arcs' numbers."""

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> bytes:
        """From words and their ids. States are merged as soon as no later word can change them, so the automaton is always minimal."""
        ordered = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, list[tuple[int, int]]]] = []  # (a word ends here, arcs (label, target)), targets first
        size: list[int] = []  # words that can be read from a state

        def settle(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append((node[0], list(node[1])))
                size.append(node[0] + sum(size[t] for _, t in node[1]))
            return register[key]

        path = [[False, []]]
        last = b""
        for word in ordered:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(node)))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        root = settle(path[0])

        first, labels, targets, numbers = array("i", [0]), bytearray(), array("i"), array("i")
        for final, arcs in states:
            number = int(final)
            for label, target in arcs:
                labels.append(label)
                targets.append(target)
                numbers.append(number)
                number += size[target]
            first.append(len(labels))
        finals = bytes(int(f) for f, _ in states)
        offsets = array("i", accumulate((len(words[w]) for w in ordered), initial=0))
        ids = array("i", (i for w in ordered for i in words[w]))
        head = array("i", [len(states), len(labels), root, len(ordered), len(ids)])
        pad = lambda data: bytes(data) + b"\0" * (-len(data) % 4)
        return b"".join([head.tobytes(), first.tobytes(), targets.tobytes(), numbers.tobytes(), offsets.tobytes(), ids.tobytes(), pad(labels), pad(finals)])

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        self.n_states, n_arcs, self.root, n_words, n_ids = view[:20].cast("i")
        at = 20
        parts = []
        for n in (self.n_states + 1, n_arcs, n_arcs, n_words + 1, n_ids):
            parts.append(view[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.number, self.offset, self.id = parts
        self.labels = at
        self.final = at + n_arcs + -n_arcs % 4
        self.n_words = n_words
        # The same arcs for many words at once: (state, label) in ascending order, numbers, targets; over the mapped file but for the first.
        self.numbers, self.targets = np.asarray(self.number), np.asarray(self.target)
        self.finals = np.frombuffer(self.map, np.uint8, self.n_states, self.final)
        sizes = np.diff(np.asarray(self.first))
        self.arcs = np.repeat(np.arange(self.n_states, dtype=np.int64), sizes) << 8 | np.frombuffer(self.map, np.uint8, n_arcs, self.labels)

    def ids(self, word: bytes) -> list[int] | None:
        """A word's ids, or None if the lexicon lacks it."""
        state, place, find, first, labels = self.root, 0, self.map.find, self.first, self.labels
        for k in range(len(word)):
            arc = find(word[k : k + 1], labels + first[state], labels + first[state + 1])
            if arc < 0:
                return None
            arc -= labels
            place += self.number[arc]
            state = self.target[arc]
        if not self.map[self.final + state] or not self.n_words:
            return None
        return self.id[self.offset[place] : self.offset[place + 1]].tolist()

    def places(self, words: pa.Array) -> np.ndarray:
        """The places of many words (large strings) at once, -1 where the lexicon lacks them: all words step through the automaton together."""
        offsets, data = raw(words)
        start, left = offsets[:-1], np.diff(offsets)
        out = np.full(len(words), -1, np.int64)
        if not self.n_words:
            return out
        at = np.flatnonzero((left > 0) & (left <= LONGEST))
        state, place = np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64)
        step = 0
        while len(at):
            wanted = state << 8 | data[start[at] + step]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            on = self.arcs[arc] == wanted
            at, arc = at[on], arc[on]
            place, state = place[on] + self.numbers[arc], self.targets[arc].astype(np.int64)
            step += 1
            ended = left[at] == step
            last = ended & (self.finals[state] != 0)
            out[at[last]] = place[last]
            at, state, place = at[~ended], state[~ended], place[~ended]
        return out


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of large strings or binaries."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return offsets, np.frombuffer(strings.buffers()[2] or b"", np.uint8)


class Coder:
    """Encodes and decodes a batch of texts at a time, without a memory of words: a batch's size is all that bounds what it holds.

    A batch's distinct words (each with the space before it and all up to the next) go through the automaton together; those that it lacks
    are merged together. Words with anything but Latin letters are split to pre-tokens first.
    """

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon

    def pre_token(self, word: str) -> list[int]:
        data = word.encode()
        ids = self.lexicon.ids(data) if self.lexicon and len(data) <= LONGEST else None
        return self.merges.merge(data) if ids is None else ids

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(self.merges.split.split(text) if self.merges.split else [text]):
            if k % 2:
                out.append(self.merges.special[piece])
            else:
                for word in PRE_TOKEN.findall(piece):
                    out += self.pre_token(word)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.merges.token.__getitem__, ids)).decode("utf-8", "replace")

    def unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and where each one's begin and end."""
        known, known_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        place = np.full(len(units), -1, np.int64)
        if self.lexicon and self.lexicon.n_words:
            known, known_at = np.asarray(self.lexicon.id), np.asarray(self.lexicon.offset).astype(np.int64)
            place = self.lexicon.places(units)
        missed = np.flatnonzero(place < 0)
        words = units.take(pa.array(missed))
        plain = np.array(plain_words(words), dtype=bool)
        made, made_at = self.merges.merge_all(words.filter(pa.array(plain)))
        rest = [self.ids(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        rest_at = np.cumsum([0, *map(len, rest)])
        first, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        at = 0
        pools = []
        for rows, pool, ends in ((np.flatnonzero(place >= 0), known, known_at), (missed[plain], made, made_at), (missed[~plain], np.array([i for r in rest for i in r], np.int32), rest_at)):
            index = place[rows] if pool is known else np.arange(len(rows))
            first[rows], size[rows] = at + ends[index], ends[index + 1] - ends[index]
            at += len(pool)
            pools.append(pool)
        ends = np.concatenate([[0], np.cumsum(size)])
        return np.concatenate(pools)[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each one's begin and end; null counts as empty."""
        column = encoders.whole(column)
        words, ends, odd = encoders.split_keeping(column)
        coded = pc.dictionary_encode(words)
        ids, at = self.unit_ids(coded.dictionary)
        unit = coded.indices.to_numpy(zero_copy_only=False)
        took = (at[1:] - at[:-1])[unit]
        stops = np.concatenate([[0], np.cumsum(took)])
        flat = ids[np.repeat(at[unit] - stops[:-1], took) + np.arange(stops[-1])]
        ends = stops[ends]
        if not odd.any():
            return flat, ends
        parts = [np.array(self.ids(column[i].as_py()), np.int32) if odd[i] else flat[ends[i] : ends[i + 1]] for i in range(len(column))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def digests(self, column: pa.Array) -> list[list]:
        """For each text: how many ids, the SHA-256 of the ids joined by commas, and that of the text decoded from them."""
        flat, ends = self.batch(column)
        numbers = pa.array(flat)
        texts, ends1 = joined(self.merges.texts.take(numbers), ends)
        data, ends2 = joined(self.merges.bytes.take(numbers), ends)
        out: list[list] = [np.diff(ends).tolist(), [], []]
        for i in range(len(ends) - 1):
            text = texts[ends1[i] : max(ends1[i], ends1[i + 1] - 1)]
            decoded = bytes(data[ends2[i] : ends2[i + 1]]).decode("utf-8", "replace")
            out[1].append(hashlib.sha256(text).hexdigest())
            out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out


def plain_words(units: pa.Array) -> pa.Array:
    """Which are one pre-token for certain: short runs of Latin letters, with or without a space before."""
    return pc.and_(pc.match_substring_regex(units, "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"), pc.less_equal(pc.binary_length(units), LONGEST))


def joined(parts: pa.Array, ends: np.ndarray) -> tuple[memoryview, list[int]]:
    """The bytes of all parts one after the other, and where those of each text end."""
    offsets, data = raw(parts)
    return memoryview(data), offsets[ends].tolist()


def count_pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, for words that can be in a lexicon; summed within a task, COUNTED words at a time, before it is sent.

    The counts only decide what the lexicon holds, never what a text encodes to.
    """

    def tally(seen: pa.Table) -> Iterator[list]:
        seen = seen.combine_chunks()
        plain = plain_words(seen["w"].combine_chunks())
        kept, rest = seen.filter(plain), seen.filter(pc.invert(plain))
        yield [kept["w"].combine_chunks(), kept["n_sum"].combine_chunks()]
        words: Counter = Counter()
        for unit, n in zip(rest["w"].to_pylist(), rest["n_sum"].to_pylist(), strict=True):
            for word in PRE_TOKEN.findall(unit):
                if len(word) <= LONGEST:
                    words[word] += n
        yield [list(words), list(words.values())]

    def run(parts) -> Iterator[list]:
        held: list[pa.Table] = []
        size = 0
        for (column,) in parts:
            column = encoders.whole(column)
            words, _, odd = encoders.split_keeping(column)
            for some in [words, encoders.split_dropping(column.filter(pa.array(odd)))[0]] if odd.any() else [words]:
                counts = pc.value_counts(some)
                held.append(pa.table({"w": counts.field(0), "n_sum": counts.field(1)}))
                size += len(counts)
            if size > COUNTED:
                held = [summed(held)]
                size = len(held[0])
                if size > COUNTED // 2:
                    yield from tally(held[0])
                    held, size = [], 0
        if held:
            yield from tally(summed(held))

    return common.emit(docs, "word string, n bigint", run, [text], rows=2048).groupBy("word").agg(F.sum("n").alias("n"))


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("w").aggregate([("n_sum", "sum")]).rename_columns(["w", "n_sum"])


def compile_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Counts, compiles and hands out a lexicon; its file's name. At most ``words`` words come to the driver.

    Which counts are high enough is read from a histogram of counts (STEPS steps for each doubling), so no task sorts all words.
    """
    counts = common.save(count_pre_tokens(docs, text).filter("n > 1"), "pre-tokens")
    step = F.floor(F.log2("n") * STEPS)
    bins = sorted(((r.step, r.words) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    held, least = 0, None
    for at, n in bins:
        if held + n > words:
            break
        held, least = held + n, at
    merges = merges_of(path)
    top = [] if least is None else counts.filter(step >= least).select("word").toArrow()["word"].to_pylist()
    # A word that is split further when it stands alone can't stand for one pre-token.
    table = {w: merges.merge(w) for w in (word.encode() for word in top if PRE_TOKEN.findall(word) == [word]) if len(w) <= LONGEST}
    return common.put_file(docs.sparkSession, "lexicon", Lexicon.build(table))


_merges: dict[str, Merges] = {}
_coders: dict[tuple[str, str], Coder] = {}


def merges_of(path: str) -> Merges:
    """One for each worker process."""
    if path not in _merges:
        _merges[path] = Merges(path)
    return _merges[path]


def coder_for(path: str, name: str):
    """A worker keeps the coder of one lexicon, from task to task."""

    def made() -> Coder:
        if (path, name) not in _coders:
            _coders.clear()
            _coders[path, name] = Coder(merges_of(path), Lexicon(SparkFiles.get(name)))
        return _coders[path, name]

    return made


def encode(docs: DataFrame, path: str, lexicon: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``ids`` appended."""
    def run(coder, column):
        ids, ends = coder.batch(column)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]

    return common.add_columns(docs, [T.StructField("ids", T.ArrayType(T.IntegerType()))], run, [text], coder_for(path, lexicon), keep)


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``decoded`` appended; null ids decode to the empty text."""
    run = lambda coder, column: [[coder.decode(i or []) for i in column.to_pylist()]]
    return common.add_columns(rows, [T.StructField("decoded", T.StringType())], run, [ids], lambda: Coder(merges_of(path), None), keep)


def digests(docs: DataFrame, path: str, lexicon: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with n_tokens and the SHA-256 of the ids and of the text decoded from them appended."""

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return common.add_columns(docs, fields, lambda coder, column: coder.digests(column), [text], coder_for(path, lexicon), keep, rows=2048)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    path = encoders.default_path("byte_bpe_50k.json")
    return digests(docs, path, compile_lexicon(docs, path), keep=["doc_id"])
