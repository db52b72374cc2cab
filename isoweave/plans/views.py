"""Domain views of the driver's tables, by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_READS = {
    "read_id": "l_orderkey * 10 + l_linenumber",
    "qname": "concat('r', cast(l_orderkey as string), '.', cast(l_linenumber as string))",
    "pair": "l_orderkey * 4 + (l_linenumber + 1) % 4",
    "sample_id": "l_orderkey % 8",
    "chrom": "concat('chr', cast(l_linenumber % 3 as string))",
    "pos": "(l_partkey % 50) * 1000",
    "cigar": "concat(cast(20 + 5 * (l_linenumber % 3) as string), 'M', cast(100 * (1 + l_partkey % 4) as string), 'N', cast(20 + 5 * (l_linenumber % 3) as string), 'M')",
    "a": "20 + 5 * (l_linenumber % 3)",
    "gap": "100 * (1 + l_partkey % 4)",
    "xs": "case when l_returnflag = 'R' then '-' else '+' end",
    "flag": "1 + case when l_partkey % 10 = 0 then 4 else 2 end + case when l_partkey % 15 = 0 then 8 else 0 end + case when l_returnflag = 'R' then 16 else 0 end + case when l_linenumber % 2 = 1 then 64 else 128 end + case when l_suppkey % 10 = 9 then 512 else 0 end + case when l_suppkey % 7 = 6 then 1024 else 0 end",
    "mapq": "l_suppkey % 61",
    "isize": "(l_partkey % 7 - 3) * 100",
    "qual": "l_quantity",
    "rnext": "case when l_suppkey % 4 = 0 then concat('chr', cast((l_linenumber + l_suppkey) % 3 as string)) else '=' end",
}
_GROUP = "case when cell % 3 = 0 then 'G1' when cell % 3 = 1 then 'S' else 'G2M' end"

#: Two-engine SQL of the views.
READS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _READS.items()) + " FROM lineitem"
READS_DUCK = READS.replace("as string)", "as varchar)")
#: ASM x path x cell grid, zero-filled as the dense matrix is.
ASM = f"""SELECT g.asm, g.path, c.cell, {_GROUP.replace('cell', 'c.cell')} AS stage, coalesce(e.expr, 0.0) AS expr
FROM (SELECT DISTINCT l_partkey % 20 AS asm, l_linenumber % 4 AS path FROM lineitem) g
CROSS JOIN (SELECT DISTINCT l_orderkey % 80 AS cell FROM lineitem) c
LEFT JOIN (SELECT l_partkey % 20 AS asm, l_linenumber % 4 AS path, l_orderkey % 80 AS cell, sum(l_quantity) AS expr FROM lineitem GROUP BY 1, 2, 3) e
ON e.asm = g.asm AND e.path = g.path AND e.cell = c.cell"""
#: Reads per cell: spike-in, cellular and unclassified ones.
DEPTH = """SELECT o_orderkey % 80 AS cell, sum(o_custkey % 100) + 1 AS ercc, sum(o_custkey % 1000) + 1 AS cellular, sum(o_custkey % 10) AS other FROM orders GROUP BY 1"""
#: Genes as intervals.
GENES = "SELECT o_orderkey AS gene, o_orderkey % 5 AS chrom, o_orderkey % 50000 * 7 AS low, o_orderkey % 50000 * 7 + o_custkey % 50 AS high FROM orders"


def lineitem(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """SQL over tables of a folder, without a view that outlives the call's names."""
    return spark.sql(_named(text, tables), **{t: lineitem(spark, sf_dir, t) for t in tables})


def _named(text: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return text


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, READS, "lineitem")


def asm_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ASM, "lineitem")


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DEPTH, "orders")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, GENES, "orders")
