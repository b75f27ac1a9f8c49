"""Near copies: SimHash candidates through the byte-position index, checked on whole sets, and an exact join for what fingerprints miss.

Two texts are linked if the Jaccard similarity of their sets of word shingles is at least ``least``. Each set has a SimHash fingerprint, and
fingerprints of at most three differing bits are found by the inverted index of positional bytes with count filtering (``simhash.links``); sets
that meet so are verified on their whole sets. Fingerprints of 64 bits can't promise all links: at 0.8 they differ in about ten bits, so no set
of whole bytes is shared for certain. So what they leave in different components goes through an inverted index over shingles with prefix and
position filters: each distinct set of n shingles, in one order for all, is posted under its first n - ceil(least * n) + 1 shingles: any two
sets that reach the similarity share one of these. The order puts shingles that are frequent in a sample last, so it decides the cost of the
lists but never the result.

There, links go in two rounds. In the first, each list's sets are compared with one leader of the list, so pairs grow with the lists. In the
second, only sets that are still in different components are compared, if their sizes and places allow the similarity. Each pair is
verified on whole sets, so the components are those of all links. Lists are made in PASSES by their keys, and pairs are verified in parts of
bounded size; each frees the disks of its tables.

Defined results: a null or empty text has the empty set, alike only to others; fewer words than a shingle make one shingle; repeated rows
and ties fall in one component, named by its smallest doc_id (nulls never name one, unless all are null); tables without rows give
tables without rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stranda.llm import common, simhash

SIZE, LEAST = 5, 0.8
#: Characters of the sample that tells frequent shingles, and how often they stand in it at least.
SAMPLE_CHARS, FREQUENT = 64_000_000, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Parts of the keys whose lists are made one after the other.
PASSES = 4
#: Whole sets of pairs that are verified at once: about so many bytes, or, if that is more, this share of the sets of all rows.
PART_BYTES, PART_SHARE = 32_000_000, 1 / 6


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The sorted set of hashes of a UTF-8 text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), simhash.SEED)], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(each) - size + 1
    out = each[:n].copy()
    for k in range(1, size):
        out *= MULTIPLIER
        out ^= out >> np.uint64(29)
        out += each[k : k + n]
    out *= MULTIPLIER
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_id(found: np.ndarray) -> int:
    return simhash.signed(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED)) if len(found) else 0


def frequent(docs: DataFrame, size: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several texts of a bounded sample, sorted, and in how many."""
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    share = min(1.0, SAMPLE_CHARS / max(total, 1))
    chosen = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).distinct()

    def run(parts):
        for (column,) in parts:
            for t in common.utf8(column):
                yield [pa.array(shingles(t, size).view(np.int64))]

    got = common.emit(chosen, "key bigint", run, ["text"]).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT).toArrow()
    keys, n = got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.int32)


def ordered(found: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted set in the order of the index: rare shingles first."""
    if not len(keys) or not len(found):
        return found
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return found[np.argsort(np.where(keys[at] == found, counts[at], 0), kind="stable")]


def prefix(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def shingle_sets(docs: DataFrame, size: int, least: float, text: str, doc_id: str) -> DataFrame:
    """(doc_id, __text_hash, set_id, n, fp, hashes) of each row: fp its set's fingerprint, the hashes those of the prefix in the order of the index; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, size, text))

    def run(state, column):
        out = [[], [], [], []]
        for t in common.utf8(column):
            found = shingles(t, size)
            out[0].append(set_id(found))
            out[1].append(len(found))
            out[2].append(simhash.signed(simhash.from_hashes(found)))
            out[3].append(ordered(found, *state)[: prefix(len(found), least) if len(found) else 0].tobytes())
        return out

    fields = [T.StructField("set_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("hashes", T.BinaryType())]
    rows = docs.select(F.col(doc_id), F.col(text), F.xxhash64(text).alias("__text_hash"))
    return common.save(common.add_columns(rows, fields, run, [text], lambda: shared.value, [doc_id, "__text_hash"]), "shingle-sets")


def postings(sets: DataFrame, least: float, part: int = 0, parts: int = 1) -> DataFrame:
    """(key, id, root, n, place): each distinct set under each shingle of its prefix whose key is in this part."""

    def run(batches):
        for ids, roots, sizes, column in batches:
            n = sizes.to_numpy(zero_copy_only=False)
            first = [prefix(k, least) if k else 0 for k in n.tolist()]
            keys = np.concatenate([np.frombuffer(d, np.int64, k) for d, k in zip(column.to_pylist(), first, strict=True)])
            places = np.concatenate([np.arange(k, dtype=np.int32) for k in first])
            mine = keys % parts == part
            yield [pa.array(keys[mine]), *(pa.array(np.repeat(c, first)[mine]) for c in (ids.to_numpy(zero_copy_only=False), roots.to_numpy(zero_copy_only=False), n)), pa.array(places[mine])]

    return common.emit(sets, "key bigint, id bigint, root bigint, n int, place int", run, ["set_id", "root", "n", "hashes"])


def mixed(posts: DataFrame) -> DataFrame:
    """The postings of lists that hold sets of different components; nearly all lists don't, and only the others are gathered."""
    lists = posts.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return posts.join(lists, "key", "left_semi")


def sized(a: str, b: str, least: float) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return F.least(n, m) >= F.greatest(n, m) * F.lit(least) - F.lit(1e-6)


def possible(a: str, b: str, least: float) -> Column:
    """Whether two sets can reach the similarity if this is the first shingle they share."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.place"), F.col(f"{b}.place")
    return F.least(n - i, m - j) * F.lit(1 + least) >= (n + m) * F.lit(least) - F.lit(1e-6)


def counted(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, n, m) of rows (a, b, n, m, first), one for each list that two sets share, where these can reach the similarity.

    ``first`` tells whether the sets can reach it if that shingle is the first they share. What the sets share beyond the shorter-reaching prefix lies in
    that one's rest, so their lists and the longer rest bound what they share.
    """
    rest = F.greatest(*[F.ceil(F.col(k) * F.lit(least) - F.lit(1e-9)) for k in "nm"]) - 1
    pairs = rows.groupBy("a", "b").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("c"), F.max("first").alias("first"))
    return pairs.filter(F.col("first") & ((F.col("c") + rest) * F.lit(1 + least) >= (F.col("n") + F.col("m")) * F.lit(least) - F.lit(1e-6))).select("a", "b", "n", "m")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, least: float, text: str) -> DataFrame:
    """The pairs (a, b) of set ids that reach the similarity, of pairs with their sizes (n, m); part by part."""
    spark, before = docs.sparkSession, common.scratch_count()
    pairs = common.save(pairs, "near-pairs")
    used = common.made_since(before)
    common.discard(spark, [])
    total = pairs.agg(F.sum(F.col("n").cast("long") + F.col("m"))).first()[0] or 0
    every = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    parts = max(1, int(np.ceil(8 * total / max(PART_BYTES, PART_SHARE * 8 * every))))
    found = None
    for part in range(parts):
        some = checked(pairs.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == part).select("a", "b"), sets, docs, size, least, text)
        found = found.unionByName(some) if found else some
    common.discard(spark, used)
    return found


def checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, least: float, text: str) -> DataFrame:
    """Those of these pairs that reach the similarity; whole sets are made again from one text of each, and freed at the end."""
    before = common.scratch_count()
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    wanted = sets.select("set_id", "__text_hash").join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("__text_hash").alias("__text_hash"))
    wanted = common.save(wanted.select("__text_hash").distinct(), "near-texts")
    chosen = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("__text_hash")).join(wanted, "__text_hash", "left_semi").select("text")

    def whole(parts):
        for (column,) in parts:
            found = [shingles(t, size) for t in common.utf8(column)]
            yield [[set_id(x) for x in found], [x.tobytes() for x in found]]

    have = common.emit(chosen, "set_id bigint, hashes binary", whole, ["text"]).groupBy("set_id").agg(F.min("hashes").alias("hashes"))
    have = common.save(have, "near-sets")
    common.discard(docs.sparkSession, [])
    both = pairs.join(have.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a").join(have.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")

    def run(parts):
        for a, b, xs, ys in parts:
            keep = []
            for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield [a.filter(mask), b.filter(mask)]

    used = common.made_since(before)
    found = common.save(common.emit(both, "a bigint, b bigint", run, ["a", "b", "x", "y"]), "near-links")
    common.discard(docs.sparkSession, used)
    return found


def alike_prints(groups: DataFrame, least: float) -> DataFrame:
    """(a, b, n, m): sets whose fingerprints are equal, or linked by the byte-position index, if their sizes allow the similarity.

    The sets of one fingerprint are compared with one of them, and these along the index's spanning forests, so pairs grow with the sets.
    """
    lead = common.save(groups.groupBy("fp").agg(F.min(F.struct("set_id", "n")).alias("l")).select("fp", "l.set_id", "l.n"), "near-prints")
    same = groups.join(lead.select("fp", F.col("set_id").alias("b"), F.col("n").alias("m")), "fp").select(F.col("set_id").alias("a"), "b", "n", "m")
    ends = [lead.select(F.col("fp").alias(fp), F.col("set_id").alias(k), F.col("n").alias(n)) for fp, k, n in (("a", "p", "n"), ("b", "q", "m"))]
    near = simhash.links(lead.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("p").alias("a"), F.col("q").alias("b"), "n", "m")
    return same.unionByName(near).filter("a <> b").filter(F.least("n", "m") >= F.greatest("n", "m") * F.lit(least) - F.lit(1e-6))


def under_roots(rows: DataFrame, edges: DataFrame, name: str, key: str = "set_id") -> DataFrame:
    """These rows with the smallest set of their component as root."""
    before = common.scratch_count()
    roots = simhash.components(edges)
    out = common.save(rows.drop("root").join(roots, F.col(key) == F.col("node"), "left").withColumn("root", F.coalesce("root", key)).drop("node"), name)
    common.discard(rows.sparkSession, common.made_since(before)[:-1])
    return out


def links(sets: DataFrame, docs: DataFrame, size: int = SIZE, least: float = LEAST, text: str = "text") -> DataFrame:
    """(a, b): links between distinct sets whose components are those of all pairs that reach the similarity."""
    spark, before = docs.sparkSession, common.scratch_count()
    groups = common.save(sets.groupBy("set_id").agg(F.first("n").alias("n"), F.first("fp").alias("fp")), "near-sizes")
    candidates = alike_prints(groups, least).distinct()
    used = common.made_since(before)
    prints = verified(candidates, sets, docs, size, least, text)
    common.discard(spark, used)

    before = common.scratch_count()
    distinct = under_roots(sets.select("set_id", "n", "hashes").dropDuplicates(["set_id"]), prints, "near-distinct")
    shared, used = None, common.made_since(before)
    before = common.scratch_count()
    for part in range(PASSES):
        some = common.save(mixed(postings(distinct, least, part, PASSES)), "near-postings")
        common.discard(spark, [])
        shared = shared.unionByName(some) if shared else some
    lists = common.made_since(before)
    common.discard(spark, used)
    # One order of leaders for all lists, so that the sets of one component meet the same few.
    lead = shared.groupBy("key").agg(F.min(F.struct("id", "n", "place", "root")).alias("l")).select("key", "l.*")
    # Two sets' lists may have other leaders, so some that could reach it are left to the second round, where all their lists are counted.
    star = shared.alias("p").join(lead.alias("l"), "key").filter((F.col("p.root") != F.col("l.root")) & sized("p", "l", least))
    star = star.select(F.col("l.id").alias("a"), F.col("p.id").alias("b"), F.col("l.n").alias("n"), F.col("p.n").alias("m"), possible("p", "l", least).alias("first"))
    first = verified(counted(star, least), sets, docs, size, least, text)

    before = common.scratch_count()
    again = under_roots(shared, prints.unionByName(first), "near-rooted", "id")
    used = [*lists, *common.made_since(before)]
    rest = common.save(mixed(again), "near-rest")
    last = common.made_since(before)[-1:]
    common.discard(spark, used)
    pairs = rest.alias("p").join(rest.alias("q"), "key").filter((F.col("p.id") < F.col("q.id")) & (F.col("p.root") != F.col("q.root")) & sized("p", "q", least))
    pairs = pairs.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.n").alias("n"), F.col("q.n").alias("m"), possible("p", "q", least).alias("first"))
    second = verified(counted(pairs, least), sets, docs, size, least, text)
    common.discard(spark, last)
    return prints.unionByName(first).unionByName(second)


def rooted(docs: DataFrame, size: int, least: float, text: str, doc_id: str) -> DataFrame:
    """(doc_id, __text_hash, set_id, root, component_id) for each row: with the component's smallest set id."""
    sets = shingle_sets(docs, size, least, text, doc_id)
    found = links(sets, docs, size, least, text)
    groups = under_roots(sets.groupBy("set_id").agg(F.min(doc_id).alias("least")), found, "near-roots")
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets.select(doc_id, "__text_hash", "set_id").join(groups.join(named, "root").select("set_id", "root", "component_id"), "set_id")


def kept(docs: DataFrame, size: int = SIZE, least: float = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, with its own columns: the one with the smallest doc_id (null only if all are).

    Which rows go is settled on the light table of ids and hashes of texts. What goes is a part of the rows, so whole rows are only moved where
    the list of it is too long to be broadcast.
    """
    spark, before = docs.sparkSession, common.scratch_count()
    found = rooted(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), size, least, "text", "doc_id")
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Repeated rows of one document are one document, and so are its texts of one set.
    light = common.save(found.groupBy("doc_id", "__text_hash").agg(F.min("set_id").alias("set_id"), F.min("root").alias("root"), F.first(named).alias("named"), F.count("*").alias("n")), "near-documents")
    common.discard(spark, common.made_since(before)[:-1])
    first = light.filter("named").groupBy("root").agg(F.min(F.struct("doc_id", "set_id", "__text_hash")).alias("r"))
    first = first.select(F.col("root").alias("first_root"), F.col("r.__text_hash").alias("first_text"), F.col("r.doc_id").alias("first_doc"))
    chosen = light.join(first, light.root == first.first_root).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("__text_hash") == F.col("first_text")))
    chosen = common.save(chosen.select(F.col("doc_id").alias("id"), F.col("__text_hash").alias("hash"), "stays", "n"), "near-chosen")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    same = F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    stay = rows.join(chosen.filter("not stays"), same, "left_anti")
    again = chosen.filter("stays and n > 1")
    if again.isEmpty():
        return stay.select("row.*")
    return stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates(["doc", "text_hash"])).select("row.*")
