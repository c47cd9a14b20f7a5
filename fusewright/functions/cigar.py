"""Column functions over CIGAR strings: ops are arrays of (op, len)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, REFERENCE, QUERY = ("M", "=", "X"), ("M", "=", "X", "D", "N"), ("M", "=", "X", "I", "S")


def parse(cigar: Column) -> Column:
    """array<struct<op string, len int>>; * and null are empty."""
    ops = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"))
    return F.transform(ops, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.left(x, F.length(x) - 1).cast("int").alias("len")))


def _sum(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(x["op"].isin(*kinds), x["len"]).otherwise(F.lit(0)))


def reference_length(ops: Column) -> Column:
    return _sum(ops, REFERENCE)


def query_length(ops: Column) -> Column:
    return _sum(ops, QUERY)


def preclip(ops: Column) -> Column:
    """Length of a clip at the start."""
    first = F.get(ops, F.lit(0))
    return F.when(first["op"].isin("S", "H"), first["len"]).otherwise(F.lit(0))


def postclip(ops: Column) -> Column:
    """Length of a clip at the end."""
    last = F.try_element_at(ops, F.lit(-1))
    return F.when(last["op"].isin("S", "H"), last["len"]).otherwise(F.lit(0))


def blocks(start: Column, ops: Column) -> Column:
    """Aligned stretches: array<struct<s int, e int>>, e is the position after the last base."""
    walked = F.aggregate(
        ops,
        F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.when(x["op"].isin(*REFERENCE), x["len"]).otherwise(F.lit(0))).cast("int").alias("at"),
            F.when(x["op"].isin(*MATCH), F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), (a["at"] + x["len"]).cast("int").alias("e"))))).otherwise(a["out"]).alias("out"),
        ),
    )
    return walked["out"]


def within_blocks(position: Column, start: Column, ops: Column) -> Column:
    """Whether a position lies in an aligned stretch, the position after its end included."""
    return F.exists(blocks(start, ops), lambda b: (position >= b["s"]) & (position <= b["e"]))


def has_long_gap(ops: Column, deletion: Column, least: int = 700_000, most: int = 1_500_000, short: int = 15) -> Column:
    """Whether a skip that is long, or part of a deletion of about that size, has only short matches on both sides.

    A side's matches are those up to the next operation that is no match, insertion, deletion or padding.
    """
    size = F.size(ops)

    def side(part: Column) -> Column:
        walked = F.aggregate(
            part,
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda a, x: F.struct(
                (a["n"] + F.when(a["on"] & x["op"].isin(*MATCH), x["len"]).otherwise(F.lit(0))).cast("int").alias("n"),
                (a["on"] & x["op"].isin(*MATCH, "D", "I", "P")).alias("on"),
            ),
        )
        return walked["n"]

    places = F.when(size > 2, F.sequence(F.lit(1), size - 2)).otherwise(F.array().cast("array<int>"))

    def bad(i: Column) -> Column:
        op = F.get(ops, i)
        long = (op["len"] >= least) | deletion.between(least, most)
        return (op["op"] == "N") & long & (side(F.reverse(F.slice(ops, F.lit(1), i))) <= short) & (side(F.slice(ops, i + 2, size)) <= short)

    return F.exists(places, bad)


def text(ops: Column) -> Column:
    """The CIGAR string of operations."""
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def spanning_intron(start: Column, ops: Column, end1: Column, start2: Column) -> Column:
    """The first skip that spans the end of one gene or the start of the next: struct of i (its place, null without one), q (bases of the read before it), at and after (where it begins and what follows).

    A fold over the operations; fewer than three have no skip between others.
    """
    state = F.struct(F.lit(0).alias("k"), start.cast("int").alias("at"), F.lit(0).alias("q"), F.lit(None).cast("struct<i:int,q:int,at:int,after:int>").alias("hit"))

    def step(a: Column, x: Column) -> Column:
        after = (a["at"] + F.when(x["op"].isin(*REFERENCE), x["len"]).otherwise(F.lit(0))).cast("int")
        spans = ((a["at"] <= end1) & (after > end1)) | ((a["at"] < start2) & (after >= start2))
        found = F.when(a["hit"].isNull() & (x["op"] == "N") & spans, F.struct(a["k"].alias("i"), a["q"].alias("q"), a["at"].alias("at"), after.alias("after")))
        q = (a["q"] + F.when(x["op"].isin(*QUERY), x["len"]).otherwise(F.lit(0))).cast("int")
        return F.struct((a["k"] + 1).alias("k"), after.alias("at"), q.alias("q"), F.coalesce(a["hit"], found).alias("hit"))

    return F.when(F.size(ops) >= 3, F.aggregate(ops, state, step)["hit"])


def _clip(beside: Column, length: Column) -> Column:
    return F.array(F.struct(F.when(beside["op"] == "H", F.lit("H")).otherwise(F.lit("S")).alias("op"), length.cast("int").alias("len")))


def from_intron(ops: Column, hit: Column) -> Column:
    """What follows the skip, with all before it clipped."""
    return F.concat(_clip(F.get(ops, F.lit(0)), hit["q"]), F.slice(ops, hit["i"] + 2, F.size(ops)))


def to_intron(ops: Column, hit: Column, read_length: Column) -> Column:
    """What precedes the skip, with all after it clipped."""
    return F.concat(F.slice(ops, F.lit(1), hit["i"]), _clip(F.try_element_at(ops, F.lit(-1)), read_length - hit["q"]))


def junctions(start: Column, ops: Column) -> Column:
    """Clips and skips as array<struct<i, direction, pos>>: a clip at the start asks for an exon's start there, another clip for an exon's end, a skip for an end before it or a start behind it."""
    kind = "array<struct<i:int,direction:string,pos:int>>"
    state = F.struct(F.lit(0).alias("i"), start.cast("int").alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        after = (a["at"] + F.when(x["op"].isin(*REFERENCE), x["len"]).otherwise(F.lit(0))).cast("int")
        at = lambda way, pos: F.struct(a["i"].alias("i"), F.lit(way).alias("direction"), pos.alias("pos"))
        clip = F.array(F.when(a["i"] == 0, at("upstream", a["at"])).otherwise(at("downstream", a["at"])))
        more = F.when(x["op"].isin("S", "H"), clip).when(x["op"] == "N", F.array(at("downstream", a["at"]), at("upstream", after))).otherwise(F.array().cast(kind))
        return F.struct((a["i"] + 1).alias("i"), after.alias("at"), F.concat(a["out"], more).cast(kind).alias("out"))

    return F.aggregate(ops, state, step)["out"]
