"""Readers and writers of the domain's text files, and a BAM data source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    rows = spark.read.text(path).withColumn("v", F.trim("value")).where("v != ''")
    return rows.where(~F.col("v").startswith("#")) if comments else rows


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, group, sample, path): ids go by group in order of its first line, then by line. A manifest is small."""
    p = F.split("v", r"\s+")
    rows = _lines(spark, path).select(F.monotonically_increasing_id().alias("line"), p[0].alias("group"), p[1].alias("sample"), p[2].alias("path"))
    first = rows.groupBy("group").agg(F.min("line").alias("first"))
    from pyspark.sql import Window

    return rows.join(first, "group").withColumn("sample_id", F.row_number().over(Window.orderBy("first", "line"))).select("sample_id", "group", "sample", "path")


def settings(spark: SparkSession, path: str, known: dict[str, str]) -> dict[str, str]:
    """Options of a whitespace-separated file over the defaults ``known``; an unknown option is an error."""
    p = F.split("v", r"\s+")
    found = {r.k: r.v for r in _lines(spark, path).select(p[0].alias("k"), p[1].alias("v")).collect()}
    if odd := set(found) - set(known):
        raise ValueError(f"unknown options: {sorted(odd)}")
    return known | found


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """Exon or junction annotation, 1-based as in the file."""
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, strand string, isoform string, gene string")


def gene_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(feature, gene, chrom, strand, low, high) of a gene annotation with a header line."""
    c = F.split("value", "\t")
    place = F.split(c[14], ":")
    rows = spark.read.text(path).where(F.size(c) >= 16).select(c[1].alias("feature"), c[15].alias("gene"), place[0].alias("chrom"), place[2].alias("strand"), F.transform(F.regexp_extract_all(place[1], F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long")).alias("b"))
    return rows.where(F.size("b") > 0).select("feature", "gene", "chrom", "strand", F.array_min("b").alias("low"), F.array_max("b").alias("high"))


def abundances(spark: SparkSession, path: str, cells: list[str]) -> DataFrame:
    """(asm, path, chrom, low, high, strand, category, cell, expr) in long form.

    Paths belong to the ASM of their own name, whatever the numbers of the paths around them are.
    """
    p = F.split(F.trim("value"), r"\s+")
    part = lambda i: F.regexp_extract(p[2], r"^([^:]+):(\d+)-(\d+):?(.*)$", i)
    values = F.transform(F.slice(p, 5, len(cells)), lambda x: x.cast("double"))
    rows = spark.read.text(path).where(F.size(p) >= 4 + len(cells)).select(p[0].alias("asm"), F.regexp_extract(p[1], r"\.p(\d+)$", 1).cast("int").alias("path"), part(1).alias("chrom"), part(2).cast("long").alias("low"), part(3).cast("long").alias("high"), part(4).alias("strand"), p[3].alias("category"), values.alias("v"))
    return rows.select("asm", "path", "chrom", "low", "high", "strand", "category", F.posexplode("v").alias("_i", "expr")).withColumn("cell", F.element_at(F.array(*map(F.lit, cells)), F.col("_i") + 1)).drop("_i")


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """(cell, ercc, cellular, other) of the transposed depth table, by row label."""
    wide = spark.read.csv(path, header=True)
    label, cells = "_label", wide.columns[1:]
    wide = wide.toDF(label, *cells)  # the first column is called Cell, as the result's
    names = {"ERCC Reads": "ercc", "Cell Reads": "cellular", "Unclassified Reads": "other"}
    long = wide.unpivot([label], cells, "cell", "value").where(F.col(label).isin(list(names)))
    return long.groupBy("cell").pivot(label, list(names)).agg(F.first(F.col("value").cast("double"))).withColumnsRenamed(names)


def cell_stages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="cell string, stage string, color string")


def spike_ins(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, cell, value) of a matrix whose first column names the transcript."""
    wide = spark.read.csv(path, header=True)
    first, *cells = wide.columns
    return wide.select(F.col(first).alias("transcript"), *(F.col(c).cast("double") for c in cells)).unpivot(["transcript"], cells, "cell", "value")


_SAM = "qname string, flag int, chrom string, pos long, mapq int, cigar string, rnext string, pnext long, isize long, seq string, qual string, xs string, tags map<string,string>"


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text; positions 0-based, strand from XS or +."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    tags = F.map_from_entries(F.array_distinct(F.transform(F.slice(c, 12, 1000), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 100_000).alias("value")))))
    named = rows.select(c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("chrom"), (c[3].cast("long") - 1).alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"), c[6].alias("rnext"), (c[7].cast("long") - 1).alias("pnext"), c[8].cast("long").alias("isize"), c[9].alias("seq"), c[10].alias("qual"), tags.alias("tags"))
    return named.withColumn("xs", F.coalesce(F.col("tags")["XS"], F.lit("+")))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): records are cut at their header, so a file of many sequences is read in parallel by record."""
    rows = spark.read.text(path, lineSep="\n>")
    clean = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(clean, r"^(\S+)", 1)
    return rows.select(name.alias("name"), F.regexp_replace(F.regexp_replace(clean, r"^[^\n]*\n?", ""), r"\s", "").alias("seq")).where("name != ''")


class BamSource(DataSource):
    """``spark.read.format("isoweave_bam").option("path", ...)``: alignments of a BAM file on a file system path.

    One partition per file (options path, path2, ...): BGZF members are inflated as a stream.
    """

    @classmethod
    def name(cls) -> str:
        return "isoweave_bam"

    def schema(self) -> str:
        return "qname string, flag int, chrom string, pos long, mapq int, cigar string, isize long, seq string, xs string"

    def reader(self, schema) -> DataSourceReader:
        return _BamReader([v for k, v in sorted(self.options.items()) if k.startswith("path")])


class _BamReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from bam_records(_inflated(partition.value))


def _inflated(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with store.open_input_stream(at) as f:
        rest, inflate = b"", zlib.decompressobj(31)
        while chunk := rest or f.read(1 << 20):
            rest = b""
            if out := inflate.decompress(chunk):
                yield out
            if inflate.eof:
                rest, inflate = inflate.unused_data, zlib.decompressobj(31)


class _Stream:
    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.buf = parts, b""

    def take(self, n: int) -> bytes:
        have = [self.buf]
        size = len(self.buf)
        while size < n:
            part = next(self.parts, None)
            if part is None:
                break
            have.append(part)
            size += len(part)
        data = b"".join(have)
        self.buf = data[n:]
        return data[:n]


def bam_records(parts: Iterator[bytes]) -> Iterator[tuple]:
    """Alignments of inflated BAM bytes; positions stay 0-based."""
    s = _Stream(parts)
    if s.take(4) != b"BAM\1":
        raise ValueError("no BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        names.append(s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode())
        s.take(4)
    while len(head := s.take(4)) == 4:
        b = s.take(struct.unpack("<i", head)[0])
        tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, _, _, isize = struct.unpack("<iiBBHHHiiii", b[:32])
        at = 32 + l_name
        ops = struct.unpack(f"<{n_cigar}I", b[at : at + 4 * n_cigar])
        cigar = "".join(f"{o >> 4}{'MIDNSHP=X'[o & 15]}" for o in ops) or "*"
        at += 4 * n_cigar
        raw = b[at : at + (l_seq + 1) // 2]
        seq = "".join("=ACMGRSVTWYHKDBN"[x >> 4] + "=ACMGRSVTWYHKDBN"[x & 15] for x in raw)[:l_seq] or "*"
        aux = b[at + (l_seq + 1) // 2 + l_seq :]
        i = aux.find(b"XSA")
        yield b[32 : at - 4 * n_cigar - 1].decode(), flag, names[tid] if tid >= 0 else "*", pos, mapq, cigar, isize, seq, aux[i + 3 : i + 4].decode() if i >= 0 else "+"


def gtf_lines(rows: DataFrame, source: str = "isoweave") -> DataFrame:
    """Nine-column lines of (chrom, feature, low, high, strand, gene, transcript)."""
    attrs = F.format_string('gene_id "%s"; transcript_id "%s";', F.col("gene").cast("string"), F.col("transcript").cast("string"))
    return rows.select(F.concat_ws("\t", "chrom", F.lit(source), "feature", F.col("low").cast("string"), F.col("high").cast("string"), F.lit("."), "strand", F.lit("."), attrs).alias("value"))


def bed12_lines(junctions: DataFrame) -> DataFrame:
    """Junction tracks of (chrom, start, end, strand, n): two blocks of 20 bases around the gap."""
    name = F.concat(F.lit("JUNC"), F.col("start").cast("string"), F.lit("_"), F.col("end").cast("string"))
    low, high = F.col("start") - 20, F.col("end") + 19
    starts = F.concat(F.lit("0,"), (F.col("end") - F.col("start") + 19).cast("string"))
    return junctions.select(F.concat_ws("\t", "chrom", low.cast("string"), high.cast("string"), name, F.col("n").cast("string"), "strand", low.cast("string"), high.cast("string"), F.lit("255,0,0"), F.lit("2"), F.lit("20,20"), starts).alias("value"))
