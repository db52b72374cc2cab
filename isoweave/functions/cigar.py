"""CIGAR strings as column expressions; positions are 0-based, intervals closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that take part of the reference: M, = and X as aligned, D and N as gaps.
_OPS = r"([0-9]+)([MIDNSHPX=])"


def operations(cigar: Column) -> Column:
    """array<struct<n: bigint, op: string>>; empty for ``*`` and nulls."""
    text = F.coalesce(cigar, F.lit("*"))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(_OPS), F.lit(1)), lambda x: x.cast("bigint"))
    kinds = F.regexp_extract_all(text, F.lit(_OPS), F.lit(2))
    return F.transform(F.arrays_zip(sizes.alias("n"), kinds.alias("op")), lambda x: F.struct(x["n"].alias("n"), x["op"].alias("op")))


def walked(pos: Column, cigar: Column) -> Column:
    """Operations with the places in reference and read at which each begins: array<struct<at, query, n, op>>.

    I, S, H and P stay where they are in the reference; = and X count as M (the reference mangles them).
    """
    empty = F.array().cast("array<struct<at: bigint, query: bigint, n: bigint, op: string>>")
    zero = F.lit(0).cast("bigint")
    start = F.struct(pos.cast("bigint").alias("at"), zero.alias("query"), empty.alias("out"))

    def step(acc, x):
        moves = F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(zero)
        reads = F.when(x["op"].isin("M", "=", "X", "I", "S"), x["n"]).otherwise(zero)
        item = F.struct(acc["at"].alias("at"), acc["query"].alias("query"), x["n"].alias("n"), F.when(x["op"].isin("=", "X"), "M").otherwise(x["op"]).alias("op"))
        return F.struct((acc["at"] + moves).alias("at"), (acc["query"] + reads).alias("query"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(operations(cigar), start, step, lambda acc: acc["out"])


def _shape(cigar: Column) -> Column:
    return F.translate(cigar, "0123456789", "")


def _numbers(cigar: Column) -> Column:
    """Sizes, as text, of the operations of reads whose shape is M or MNM."""
    return F.split(F.translate(cigar, "MN", "  "), " ")  # a single plain character needs no regular expression


def _by_shape(cigar: Column, whole, spliced, rest: Column, shape: Column | None = None, numbers: Column | None = None) -> Column:
    """``whole(n)`` for reads of one aligned block, ``spliced(a, gap, b)`` for two around one gap, else ``rest``.

    Most reads are of these shapes; they need one split in compiled code and no fold over operations.
    """
    shape, part = _shape(cigar) if shape is None else shape, _numbers(cigar) if numbers is None else numbers
    n = [F.when(part[i] != "", part[i]).cast("bigint") for i in range(3)]  # a cast that can't fail: failures are slow
    return F.when(shape == "MNM", spliced(*n)).when(shape == "M", whole(n[0])).otherwise(rest)


def exons(pos: Column, cigar: Column, *known: Column) -> Column:
    """array<struct<start, end>>: each aligned block; a deletion splits it."""
    at = pos.cast("bigint")
    block = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    rest = F.transform(F.filter(walked(pos, cigar), lambda x: x["op"] == "M"), lambda x: block(x["at"], x["at"] + x["n"] - 1))
    return _by_shape(cigar, lambda n: F.array(block(at, at + n - 1)), lambda a, gap, b: F.array(block(at, at + a - 1), block(at + a + gap, at + a + gap + b - 1)), rest, *known)


def junctions(pos: Column, cigar: Column, *known: Column) -> Column:
    """array<struct<start, end>>: last base before and first base after each N."""
    at = pos.cast("bigint")
    gap_of = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    rest = F.transform(F.filter(walked(pos, cigar), lambda x: x["op"] == "N"), lambda x: gap_of(x["at"] - 1, x["at"] + x["n"]))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return _by_shape(cigar, lambda n: none, lambda a, gap, b: F.array(gap_of(at + a - 1, at + a + gap)), rest, *known)


def aligned_blocks(pos: Column, cigar: Column, *known: Column) -> Column:
    """array<struct<start, query, n>>: each aligned block with its 0-based place in the read."""
    at, zero = pos.cast("bigint"), F.lit(0).cast("bigint")
    block = lambda a, q, n: F.struct(a.alias("start"), q.alias("query"), n.alias("n"))
    rest = F.transform(F.filter(walked(pos, cigar), lambda x: x["op"] == "M"), lambda x: block(x["at"], x["query"], x["n"]))
    return _by_shape(cigar, lambda n: F.array(block(at, zero, n)), lambda a, gap, b: F.array(block(at, zero, a), block(at + a + gap, a, b)), rest, *known)


def inlined(rows: DataFrame, of, *columns: str) -> DataFrame:
    """``columns`` and the fields of the blocks that ``of`` (exons, junctions or aligned_blocks) finds, a row for each.

    What several expressions need is made in a projection of its own, and the outer generator keeps the optimiser from
    making the blocks a second time in a filter for empty ones.
    """
    marked = rows.select(*columns, F.col("pos").alias("_pos"), F.col("cigar").alias("_cigar"), _shape(F.col("cigar")).alias("_shape"), _numbers(F.col("cigar")).alias("_n"))
    blocks = of(F.col("_pos"), F.col("_cigar"), F.col("_shape"), F.col("_n"))
    return marked.select(*columns, blocks.alias("_blocks")).select(*columns, F.inline_outer("_blocks")).where("start is not null")


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that a read spans."""
    rest = F.aggregate(operations(cigar), F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(0))
    return _by_shape(cigar, lambda n: n, lambda a, gap, b: a + gap + b, rest)
