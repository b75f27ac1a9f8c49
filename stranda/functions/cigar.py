"""CIGAR strings as arrays of (len, op), and what follows from them. ``*`` is the empty array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READ_OPS, REF_OPS, CLIPS, ALIGNED = "MIS=X", "MDN=X", "SH", "M=X"
TEXT = r"^(\*|([0-9]+[MIDNSHP=X])+)$"


def is_valid_text(cigar: Column) -> Column:
    return cigar.rlike(TEXT)


def elements(cigar: Column) -> Column:
    """array<struct<len,op>>; null for a text that isn't a CIGAR."""
    part = F.lit(r"([0-9]+)([MIDNSHP=X])")
    known = F.when(is_valid_text(cigar), cigar)
    return F.arrays_zip(F.regexp_extract_all(known, part, F.lit(1)).cast("array<int>"), F.regexp_extract_all(known, part, F.lit(2))).cast("array<struct<len:int,op:string>>")


def text(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, "*").otherwise(F.array_join(F.transform(parts, lambda p: F.concat(p["len"].cast("string"), p["op"])), ""))


def from_operators(ops: Column) -> Column:
    """Run-length encodes a string of operators: ``MMMID`` is ``3M1I1D``."""
    runs = F.regexp_extract_all(ops, F.lit(r"(?:M+|I+|D+|N+|S+|H+|P+|=+|X+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))), "")


def consumes_read(op: Column) -> Column:
    return op.isin(*READ_OPS)


def consumes_reference(op: Column) -> Column:
    return op.isin(*REF_OPS)


def total(parts: Column, ops: str) -> Column:
    """Sum of the lengths of some operators."""
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.when(p["op"].isin(*ops), p["len"]).otherwise(0))


def reference_length(parts: Column) -> Column:
    return total(parts, REF_OPS)


def text_end(start: Column, cigar: Column) -> Column:
    """``alignment_end`` from the text, without its elements."""
    lengths = F.regexp_extract_all(F.when(is_valid_text(cigar), cigar), F.lit(f"([0-9]+)[{REF_OPS}]"), F.lit(1)).cast("array<int>")
    return start + F.aggregate(lengths, F.lit(0), lambda acc, n: acc + n) - 1


def padded_reference_length(parts: Column) -> Column:
    return total(parts, REF_OPS + "P")


def read_length(parts: Column) -> Column:
    return total(parts, READ_OPS)


def inserted_bases(parts: Column) -> Column:
    return total(parts, "I")


def deleted_bases(parts: Column) -> Column:
    return total(parts, "D")


def mismatches_from_ops(parts: Column) -> Column:
    """NM of a CIGAR with = and X: mismatches, inserted and deleted bases."""
    return total(parts, "XID")


def has(parts: Column, op: str) -> Column:
    return F.exists(parts, lambda p: p["op"] == op)


def left_clipped(parts: Column) -> Column:
    return F.coalesce(F.get(parts, F.lit(0))["op"].isin(*CLIPS), F.lit(False))


def right_clipped(parts: Column) -> Column:
    return F.coalesce(F.get(parts, F.size(parts) - 1)["op"].isin(*CLIPS), F.lit(False))


def clipped(parts: Column) -> Column:
    return left_clipped(parts) | right_clipped(parts)


def leading_clips(parts: Column) -> Column:
    """S and H before the first other operator."""
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, p: F.struct((acc["n"] + F.when(acc["open"] & p["op"].isin(*CLIPS), p["len"]).otherwise(0)).alias("n"), (acc["open"] & p["op"].isin(*CLIPS)).alias("open")),
    )
    return walk["n"]


def trailing_clips(parts: Column) -> Column:
    return leading_clips(F.reverse(parts))


def alignment_end(start: Column, parts: Column) -> Column:
    return start + reference_length(parts) - 1


def unclipped_start(start: Column, parts: Column) -> Column:
    return start - leading_clips(parts)


def unclipped_end(start: Column, parts: Column) -> Column:
    return alignment_end(start, parts) + trailing_clips(parts)


def five_prime(negative: Column, start: Column, parts: Column) -> Column:
    """The unclipped coordinate of the read's first cycle."""
    return F.when(negative, unclipped_end(start, parts)).otherwise(unclipped_start(start, parts))


def walk(start: Column, parts: Column) -> Column:
    """array<struct<op,len,read_start,ref_start>>: each element with the 1-based positions at which it begins."""
    empty = F.array().cast("array<struct<op:string,len:int,read_start:int,ref_start:int>>")
    first = F.struct(F.lit(1).alias("read"), start.cast("int").alias("ref"), empty.alias("out"))

    def step(acc, p):
        here = F.struct(p["op"].alias("op"), p["len"].alias("len"), acc["read"].alias("read_start"), acc["ref"].alias("ref_start"))
        return F.struct(
            (acc["read"] + F.when(consumes_read(p["op"]), p["len"]).otherwise(0)).alias("read"),
            (acc["ref"] + F.when(consumes_reference(p["op"]), p["len"]).otherwise(0)).alias("ref"),
            F.concat(acc["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(parts, first, step)["out"]


def blocks(start: Column, parts: Column) -> Column:
    """array<struct<read_start,ref_start,len>>: the ungapped blocks."""
    aligned = F.filter(walk(start, parts), lambda p: p["op"].isin(*ALIGNED))
    return F.transform(aligned, lambda p: F.struct(p["read_start"].alias("read_start"), p["ref_start"].alias("ref_start"), p["len"].alias("len")))


def ref_position(start: Column, parts: Column, read_position: Column) -> Column:
    """The reference position of a 1-based read position; 0 if it is inserted or clipped."""
    hit = F.filter(blocks(start, parts), lambda b: read_position.between(b["read_start"], b["read_start"] + b["len"] - 1))
    first = F.get(hit, F.lit(0))
    return F.coalesce(first["ref_start"] + read_position - first["read_start"], F.lit(0))


def read_position(start: Column, parts: Column, position: Column, last_before_deletion: bool = False) -> Column:
    """The 1-based read position at a reference position; 0 if it is deleted (or else the last base before)."""
    all_blocks = blocks(start, parts)
    hit = F.get(F.filter(all_blocks, lambda b: position.between(b["ref_start"], b["ref_start"] + b["len"] - 1)), F.lit(0))
    found = hit["read_start"] + position - hit["ref_start"]
    if last_before_deletion:
        before = F.filter(all_blocks, lambda b: b["ref_start"] + b["len"] - 1 < position)
        after = F.exists(all_blocks, lambda b: b["ref_start"] > position)
        last = F.get(before, F.size(before) - 1)
        found = F.coalesce(found, F.when(after, last["read_start"] + last["len"] - 1))
    return F.coalesce(found, F.lit(0))


def merge_adjacent(parts: Column) -> Column:
    """Neighbouring elements of one operator as one; elements of length 0 go."""
    empty = F.array().cast("array<struct<len:int,op:string>>")

    def step(acc, p):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["len"] + p["len"]).alias("len"), p["op"].alias("op"))))
        return F.when(p["len"] == 0, acc).when((F.size(acc) > 0) & (last["op"] == p["op"]), joined).otherwise(F.concat(acc, F.array(F.struct(p["len"].alias("len"), p["op"].alias("op")))))

    return F.aggregate(parts, empty, step)


def clip_from(parts: Column, position: Column, op: str = "S") -> Column:
    """Clips a read from a 1-based position to its end; what was clipped there already joins the new clip."""
    moved = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("read"), F.array().cast("array<struct<len:int,op:string>>").alias("out"), F.lit(0).alias("cut"), F.lit(0).alias("hard")),
        lambda acc, p: F.struct(
            (acc["read"] + F.when(consumes_read(p["op"]), p["len"]).otherwise(0)).alias("read"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        F.when(p["op"] == "H", F.when(acc["read"] == 0, p["len"]).otherwise(0))
                        .when(acc["read"] >= position - 1, 0)
                        .when(consumes_read(p["op"]), F.least(p["len"], position - 1 - acc["read"]))
                        .otherwise(p["len"])
                        .cast("int")
                        .alias("len"),
                        p["op"].alias("op"),
                    )
                ),
            ).alias("out"),
            (acc["cut"] + F.when(consumes_read(p["op"]), p["len"] - F.greatest(F.lit(0), F.least(p["len"], position - 1 - acc["read"]))).otherwise(0)).cast("int").alias("cut"),
            F.when((p["op"] == "H") & (acc["read"] > 0), p["len"]).otherwise(acc["hard"]).alias("hard"),
        ),
    )
    tail = F.array(F.struct((moved["cut"] + (moved["hard"] if op == "H" else F.lit(0))).cast("int").alias("len"), F.lit(op).alias("op")))
    rest = F.array(F.struct(moved["hard"].alias("len"), F.lit("H").alias("op"))) if op == "S" else F.array().cast("array<struct<len:int,op:string>>")
    return merge_adjacent(F.concat(moved["out"], tail, rest))


def mate_overlap_to_clip(start: Column, parts: Column, mate_start: Column) -> Column:
    """Bases of the left-most read that reach over its mate's start: of M what lies beyond it, of =, X and I all."""
    reached = F.filter(walk(start, parts), lambda p: p["ref_start"] + F.when(consumes_reference(p["op"]), p["len"]).otherwise(0) - 1 >= mate_start)
    return F.aggregate(
        reached,
        F.lit(0),
        lambda acc, p: acc + F.when(p["op"] == "M", p["ref_start"] + p["len"] - F.greatest(p["ref_start"], mate_start)).when(p["op"].isin("=", "X", "I"), p["len"]).otherwise(0),
    )


def is_sound(cigar: Column) -> Column:
    """Whether a text is a CIGAR with an element at least and without ``errors``: the same rules as patterns over the text, far cheaper; null stays null."""
    ops = F.regexp_replace(cigar, "[0-9]+", "")
    wrong = r"^.+H.+$|[^H].*S.*[^H]|^P|P$|II|DD|^[^M=XIDN]*$"
    return is_valid_text(cigar) & (cigar != "*") & ~cigar.rlike("(?:^|[A-Z=])0+[A-Z=]") & ~ops.rlike(wrong)


def errors(parts: Column) -> Column:
    """Array of what is wrong: zero lengths, misplaced clips or padding, neighbouring indels, no real operator."""
    n = F.size(parts)
    at = lambda i: F.get(parts, i)
    inner = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    before = lambda i, ops: F.forall(F.slice(parts, F.lit(1), i), lambda p: p["op"].isin(*ops))
    after = lambda i, ops: F.forall(F.slice(parts, i + 2, F.greatest(n, F.lit(1))), lambda p: p["op"].isin(*ops))
    found = [
        ("ZERO_LENGTH", F.exists(parts, lambda p: p["len"] == 0)),
        ("HARD_CLIP_PLACE", F.exists(inner, lambda i: (at(i)["op"] == "H") & (i > 0) & (i < n - 1))),
        ("SOFT_CLIP_PLACE", F.exists(inner, lambda i: (at(i)["op"] == "S") & ~before(i, "H") & ~after(i, "H"))),
        ("PADDING_PLACE", F.exists(inner, lambda i: (at(i)["op"] == "P") & ((i == 0) | (i == n - 1)))),
        ("ADJACENT_INDELS", F.exists(inner, lambda i: at(i)["op"].isin("I", "D") & (at(i)["op"] == at(i + 1)["op"]))),
        ("NO_REAL_OPERATOR", ~F.exists(parts, lambda p: p["op"].isin("M", "=", "X", "I", "D", "N"))),
    ]
    named = F.array(*[F.when(bad & (n > 0), F.lit(name)) for name, bad in found])
    return F.filter(named, lambda x: x.isNotNull())
