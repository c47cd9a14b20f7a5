"""BAM files by the public format, as a data source whose partitions are byte ranges of the files.

A range starts at the first BGZF block header in it and at the first plausible record from there;
it owns the records that start in its blocks and reads on behind its end for the last of them. Each
record's virtual offset (block << 16 | place in the block) is a column, from which a table of bins
and windows is made; with that index, or a .bai file, a region's records are read from the blocks
that can hold them only. Files are opened by pyarrow's file systems.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import cigar as cg
from ..functions import sequence as sq

SEQ, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
RAW = "qname string, flag int, name string, pos int, cigar string, mate_name string, mate_pos int, seq string, hi int, has_sa boolean, voffset bigint, file string"
KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64()}
NAMES = [x.split()[0] for x in RAW.split(", ")]
TYPES = [KINDS[x.split()[1]] for x in RAW.split(", ")]
MAGIC = b"\x1f\x8b\x08\x04"
#: Bytes of a file that are one partition, unless told; compressed data grows about fourfold.
SPLIT = 32 << 20
ROWS = 4096
#: Records in a row that must be plausible where a range starts.
CHAIN = 6
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_NIBBLES = str.maketrans("0123456789abcdef", SEQ)
_FIXED = struct.Struct("<iiiBBHHHiiii")  # block_size, ref, pos, l_name, mapq, bin, n_ops, flag, l_seq, mate, mate_pos, tlen
_INT = struct.Struct("<i")


def opened(path: str) -> pa.NativeFile:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def files_of(path: str) -> list[tuple[str, int]]:
    """The path and size of a file, or of the .bam files of a folder."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    told = fs.get_file_info(at)
    if told.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if told.type == pafs.FileType.File:
        return [(path, told.size)]
    below = sorted((x for x in fs.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".bam")), key=lambda x: x.path)
    return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in below]


def block_size(head: bytes, at: int = 0) -> int | None:
    """The size of the BGZF block whose header stands there; None if there is no such header."""
    if head[at : at + 4] != MAGIC or len(head) < at + 18:
        return None
    end = at + 12 + struct.unpack_from("<H", head, at + 10)[0]
    x = at + 12
    while x + 4 <= min(end, len(head)):
        length = struct.unpack_from("<H", head, x + 2)[0]
        if head[x : x + 2] == b"BC" and length == 2 and x + 6 <= len(head):
            return struct.unpack_from("<H", head, x + 4)[0] + 1
        x += 4 + length
    return None


def first_block(f: pa.NativeFile, at: int, size: int) -> int:
    """The place of the first block from `at` on: a header whose successor is a header too, or the file's end."""
    f.seek(at)
    data = f.read(min(size - at, 3 << 16))
    x = data.find(MAGIC)
    while x >= 0:
        n = block_size(data, x)
        if n and (at + x + n == size or block_size(data, x + n)):
            return at + x
        x = data.find(MAGIC, x + 1)
    return size


class Blocks:
    """Inflated blocks from a place on, as a growing buffer; `where` tells the virtual offset of a place in it."""

    def __init__(self, f: pa.NativeFile, at: int, size: int, step: int = 1 << 20, stop: int = 1 << 62):
        self.f, self.at, self.size, self.step, self.stop = f, at, size, step, stop
        self.raw, self.raw_at = memoryview(b""), 0
        self.buf, self.p = b"", 0
        self.starts: list[int] = []
        self.blocks: list[int] = []

    def more(self, least: int) -> None:
        """Inflates on until `least` bytes stand behind p, or the file ends; blocks that lie before p are dropped."""
        parts, have = [self.buf[self.p :]], len(self.buf) - self.p
        k = max(0, bisect_right(self.starts, self.p) - 1)
        self.starts, self.blocks = [s - self.p for s in self.starts[k:]], self.blocks[k:]
        self.p = 0
        # several blocks at a time, but none behind `stop` that isn't needed
        while self.at < self.size and (have < least or (have < 1 << 18 and self.at <= self.stop)):
            data = self._block()
            self.starts.append(have)
            parts.append(data)
            have += len(data)
        self.buf = b"".join(parts)

    def _block(self) -> bytes:
        if len(self.raw) - self.raw_at < 1 << 16 and self.at + len(self.raw) - self.raw_at < self.size:
            self.f.seek(self.at)
            self.raw, self.raw_at = memoryview(self.f.read(min(self.step, self.size - self.at))), 0
        n = block_size(self.raw[self.raw_at : self.raw_at + 64].tobytes())
        if not n or self.raw_at + n > len(self.raw):
            raise ValueError(f"no BGZF block at byte {self.at}")
        xlen = struct.unpack_from("<H", self.raw, self.raw_at + 10)[0]
        body = self.raw[self.raw_at + 12 + xlen : self.raw_at + n - 8]
        data = zlib.decompress(body, -15)
        if zlib.crc32(data) != struct.unpack_from("<I", self.raw, self.raw_at + n - 8)[0]:
            raise ValueError(f"checksum of the block at byte {self.at}")
        self.blocks.append(self.at)
        self.at += n
        self.raw_at += n
        return data

    def here(self, n: int) -> bool:
        if len(self.buf) - self.p < n:
            self.more(n)
        return len(self.buf) - self.p >= n

    def where(self) -> int:
        """The virtual offset of p."""
        k = bisect_right(self.starts, self.p) - 1
        return self.blocks[k] << 16 | (self.p - self.starts[k])

    def take(self, n: int) -> bytes:
        if not self.here(n):
            raise ValueError("truncated BAM")
        self.p += n
        return self.buf[self.p - n : self.p]


class Members(Blocks):
    """A gzip stream that isn't made of BGZF blocks: inflated in order, chunk by chunk; there are no virtual offsets."""

    def __init__(self, f: pa.NativeFile, at: int, size: int, step: int = 1 << 16, stop: int = 1 << 62):
        super().__init__(f, at, size, step, stop)
        self.z = zlib.decompressobj(31)

    def _block(self) -> bytes:
        self.f.seek(self.at)
        raw = self.f.read(self.step)
        out = self.z.decompress(raw)
        left = len(self.z.unused_data)
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.blocks.append(0)
        self.at += len(raw) - left
        return out


@dataclass(frozen=True)
class Header:
    names: tuple[str, ...]
    lengths: tuple[int, ...]
    first: int
    blocked: bool


def header(path: str, size: int) -> Header:
    """Contigs with their lengths, and the virtual offset of the first record."""
    with opened(path) as f:
        blocked = block_size(f.read(64)) is not None
        s = (Blocks if blocked else Members)(f, 0, size, stop=-1)
        if s.take(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file; CRAM is not supported")
        s.take(_INT.unpack(s.take(4))[0])
        names, lengths = [], []
        for _ in range(_INT.unpack(s.take(4))[0]):
            names.append(s.take(_INT.unpack(s.take(4))[0])[:-1].decode())
            lengths.append(_INT.unpack(s.take(4))[0])
        return Header(tuple(names), tuple(lengths), s.where() if s.here(1) else size << 16, blocked)


def plausible(b: bytes, at: int, lengths: Sequence[int]) -> int | None:
    """The size of the record that can stand there; None if none can."""
    if at + 36 > len(b):
        return None
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos, _ = _FIXED.unpack_from(b, at)
    if not (-1 <= ref < len(lengths) and -1 <= mate < len(lengths) and l_name > 0 and l_seq >= 0):
        return None
    if not (-1 <= pos <= (lengths[ref] if ref >= 0 else 1 << 31) and -1 <= mate_pos <= (lengths[mate] if mate >= 0 else 1 << 31)):
        return None
    if not 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq <= size < 1 << 28:
        return None
    name = b[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(32 < x < 127 for x in name[:-1])):
        return None
    ops = b[at + 36 + l_name : at + 36 + l_name + 4 * n_ops]
    if len(ops) == 4 * n_ops and any(x & 15 > 8 for x in struct.unpack(f"<{n_ops}I", ops)):
        return None
    return size + 4


def synchronise(s: Blocks, lengths: Sequence[int], end: int) -> bool:
    """Moves to the first place where a chain of records stands; False if none begins in a block before `end`."""
    while s.here(1):
        far, seen, fits = 0, 0, True
        while fits and seen < CHAIN and s.here(far + 1):
            n = plausible(s.buf, s.p + far, lengths) if s.here(far + 36) else None
            fits = n is not None and s.here(far + n)
            seen, far = seen + 1, far + (n or 0)
        if fits and seen:  # the chain may end with the file
            return s.where() >> 16 < end
        s.p += 1
        if s.here(1) and s.where() >> 16 >= end:
            break
    return False


def _tags(b: bytes) -> tuple[int | None, bool]:
    """The hit index, and whether there is a supplementary alignment."""
    at, hi, sa = 0, None, False
    while at + 3 <= len(b):
        tag, kind = b[at : at + 2], chr(b[at + 2])
        at += 3
        if kind in "ZH":
            end = b.index(0, at)
            sa = sa or tag == b"SA"
            at = end + 1
        elif kind == "B":
            sub, n = chr(b[at]), _INT.unpack_from(b, at + 1)[0]
            at += 5 + n * _SIZES[sub]
        else:
            if tag == b"HI" and kind in _CODES:
                hi = struct.unpack_from(_CODES[kind], b, at)[0]
            at += _SIZES[kind]
    return hi, sa


@lru_cache(1 << 16)
def _cigar(ops: bytes) -> str:
    return "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack(f"<{len(ops) // 4}I", ops)) or "*"


def records(s: Blocks, names: Sequence[str], end: int, path: str) -> Iterator[tuple]:
    """Rows of RAW of the records that start before the virtual offset `end`."""
    while (s.p < len(s.buf) or s.at << 16 < end) and s.here(4):
        at = s.where()
        if at >= end:
            return
        if not s.here(4 + _INT.unpack_from(s.buf, s.p)[0]):
            raise ValueError("truncated BAM")
        b, p = s.buf, s.p
        size, ref, pos, l_name, _, _, n_ops, flag, l_seq, mate, mate_pos, _ = _FIXED.unpack_from(b, p)
        s.p = stop = p + 4 + size
        x = p + 36 + l_name
        qname = b[p + 36 : x - 1].decode()
        y = x + 4 * n_ops
        z = y + (l_seq + 1) // 2
        hi, sa = _tags(b[z + l_seq : stop])
        yield qname, flag, names[ref] if ref >= 0 else None, pos, _cigar(b[x:y]), names[mate] if mate >= 0 else None, mate_pos, b[y:z].hex().translate(_NIBBLES)[:l_seq], hi, sa, at, path


@dataclass
class Range(InputPartition):
    """Records that start at virtual offsets from start up to end; a start that isn't exact is looked for."""

    path: str
    size: int
    head: Header
    start: int
    end: int
    exact: bool


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Range]:
        """Byte ranges of all files, or the chunks told (path start end, virtual offsets, a line each)."""
        out, split = [], int(self.options.get("split", SPLIT))
        chunks = self.options.get("chunks")
        sizes = dict(files_of(self.options["path"]))
        if chunks is not None:
            heads = {p: header(p, n) for p, n in sizes.items()}
            for line in chunks.splitlines():
                path, a, b = line.rsplit(" ", 2)
                out.append(Range(path, sizes[path], heads[path], int(a), int(b), True))
            return out
        for path, size in sizes.items():
            h = header(path, size)
            if not h.blocked:
                out.append(Range(path, size, h, 0, 1 << 62, True))
                continue
            first = h.first >> 16
            cuts = list(range(first, size, split)) or [first]
            for i, a in enumerate(cuts):
                b = cuts[i + 1] if i + 1 < len(cuts) else size
                out.append(Range(path, size, h, h.first if i == 0 else a << 16, b << 16, i == 0))
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there were no partitions
            return
        with opened(part.path) as f:
            if not part.head.blocked:
                s = Members(f, 0, part.size)
                s.take(4)
                s.take(_INT.unpack(s.take(4))[0])
                for _ in range(_INT.unpack(s.take(4))[0]):
                    s.take(_INT.unpack(s.take(4))[0])
                    s.take(4)
                part.end = 1 << 62
            elif part.exact:
                s = Blocks(f, part.start >> 16, part.size, min(1 << 20, max(1 << 17, (part.end - part.start >> 16) + (1 << 16))), part.end >> 16)
                if part.start >> 16 >= part.size:
                    return
                s.take(part.start & 0xFFFF)
            else:
                at = first_block(f, part.start >> 16, part.size)
                s = Blocks(f, at, part.size, stop=part.end >> 16)
                if at >= part.end >> 16 or not synchronise(s, part.head.lengths, part.end >> 16):
                    return
            held: list[tuple] = []
            for r in records(s, part.head.names, part.end, part.path):
                held.append(r)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), TYPES)], names=NAMES)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), TYPES)], names=NAMES)


class BamSource(DataSource):
    """spark.read.format("fusewright_bam"); options: path, split (bytes), chunks."""

    @classmethod
    def name(cls) -> str:
        return "fusewright_bam"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: object) -> BamReader:
        return BamReader(dict(self.options))


def raw(spark: SparkSession, path: str, split: int = SPLIT, chunks: str | None = None) -> DataFrame:
    """All fields of a file, or of the .bam files of a folder."""
    spark.dataSource.register(BamSource)
    r = spark.read.format("fusewright_bam").option("split", split)
    return (r if chunks is None else r.option("chunks", chunks)).load(path)


def as_sam(d: DataFrame) -> DataFrame:
    c = F.col
    return d.select("qname", "flag", sq.strip_chr(c("name")).alias("contig"), "pos", "cigar", sq.strip_chr(c("mate_name")).alias("mate_contig"), "mate_pos", "seq", "hi", "has_sa")


def bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The columns of text.sam(), by as many tasks as the files have byte ranges."""
    return as_sam(raw(spark, path, split))


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """contig, length of the headers."""
    seen = {(n, k) for p, size in files_of(path) for h in [header(p, size)] for n, k in zip(h.names, h.lengths)}
    d = spark.createDataFrame(sorted(seen), "name string, length bigint")
    return d.select(sq.strip_chr(F.col("name")).alias("contig"), "length").distinct()


#: Fixed values of the format: bins of 2^29, 2^26, 2^23, 2^20, 2^17 and 2^14 bases, and the first number of each level; windows of 2^14.
LEVELS, WINDOW = ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)), 14


def bins_of(start: int, end: int) -> list[int]:
    """The bins that can hold what overlaps [start, end)."""
    return [first + k for shift, first in LEVELS for k in range(start >> shift, (end - 1 >> shift) + 1)]


def index(spark: SparkSession, path: str, split: int = SPLIT, run: int = 1 << 18) -> DataFrame:
    """file, name, kind (bin or window), key, first, last: virtual offsets of a coordinate-sorted file's records by bin, and the least of each window.

    A bin's records lie in several runs, at most one for each `run` bytes of the file.
    """
    c = F.col
    d = raw(spark, path, split).where("name is not null and pos >= 0")
    d = d.withColumn("end", c("pos") + F.greatest(cg.reference_length(cg.parse(c("cigar"))), F.lit(1)))
    best = F.lit(0)
    for shift, first in LEVELS[1:]:
        a, b = F.shiftright("pos", shift), F.shiftright(c("end") - 1, shift)
        best = F.when(a == b, first + a).otherwise(best)
    d = d.select("file", "name", best.cast("bigint").alias("key"), "voffset", F.shiftright("pos", WINDOW).alias("w0"), F.shiftright(c("end") - 1, WINDOW).alias("w1"))
    block = F.shiftright("voffset", 16)
    runs = d.groupBy("file", "name", "key", F.floor(block / run).alias("part")).agg(F.min("voffset").alias("first"), F.max("voffset").alias("last"))
    windows = d.select("file", "name", F.explode(F.sequence(c("w0").cast("bigint"), c("w1").cast("bigint"))).alias("key"), "voffset").groupBy("file", "name", "key").agg(F.min("voffset").alias("first"))
    return runs.drop("part").withColumn("kind", F.lit("bin")).unionByName(windows.withColumn("kind", F.lit("window")).withColumn("last", c("first"))).select("file", "name", "kind", "key", "first", "last")


def bai(spark: SparkSession, path: str, bam_path: str) -> DataFrame:
    """The rows of index() from a .bai file."""
    with opened(path) as f:
        b = f.read()
    if b[:4] != b"BAI\1":
        raise ValueError(f"{path} is no BAI file")
    (size,) = (n for p, n in files_of(bam_path) if p == bam_path)
    names = header(bam_path, size).names
    at, rows = 8, []
    for name in names[: _INT.unpack_from(b, 4)[0]]:
        (n_bins,) = _INT.unpack_from(b, at)
        at += 4
        for _ in range(n_bins):
            key, n = struct.unpack_from("<Ii", b, at)
            at += 8
            if key < 37450:  # the pseudo bin holds counts
                rows += [(bam_path, name, "bin", key, *struct.unpack_from("<QQ", b, at + 16 * i)) for i in range(n)]
            at += 16 * n
        (n,) = _INT.unpack_from(b, at)
        rows += [(bam_path, name, "window", i, v, v) for i, v in enumerate(struct.unpack_from(f"<{n}Q", b, at + 4)) if v]
        at += 4 + 8 * n
    # a chunk ends before its second offset, a run at its last record
    d = spark.createDataFrame(rows, "file string, name string, kind string, key bigint, first bigint, last bigint")
    return d.withColumn("last", F.when(F.col("kind") == "bin", F.col("last") - 1).otherwise(F.col("last")))


def chunks_of(ix: DataFrame, contig: str, start: int, end: int, near: int = 1 << 16) -> list[tuple[str, int, int]]:
    """(file, first, last) of the runs that can hold records of [start, end); those within `near` bytes are one. As many rows as there are runs come to the driver."""
    c = F.col
    own = ix.where(sq.strip_chr(c("name")) == contig)
    # what starts before the region's first window was reached can't overlap it
    floor = own.where((c("kind") == "window") & (c("key") >= start >> WINDOW)).groupBy("file").agg(F.min_by("first", "key").alias("floor"))
    hit = own.where((c("kind") == "bin") & c("key").isin(bins_of(start, end))).join(floor, "file").where("last >= floor")
    hit = hit.select("file", F.greatest("first", "floor").alias("first"), "last")
    before = F.max("last").over(Window.partitionBy("file").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    hit = hit.withColumn("new", (F.coalesce(F.shiftright(before, 16), F.lit(-(1 << 20))) < F.shiftright("first", 16) - near).cast("int"))
    run = F.sum("new").over(Window.partitionBy("file").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0))
    got = hit.withColumn("run", run).groupBy("file", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return sorted(tuple(r) for r in got.select("file", "first", "last").collect())


def region(spark: SparkSession, path: str, ix: DataFrame, contig: str, start: int, end: int, near: int = 1 << 16) -> DataFrame:
    """The records of bam() that overlap [start, end) (0-based) of a contig, from the blocks that the index names."""
    chunks = "\n".join(f"{f} {a} {b + 1}" for f, a, b in chunks_of(ix, contig, start, end, near))
    d = as_sam(raw(spark, path, chunks=chunks))
    length = F.greatest(cg.reference_length(cg.parse(F.col("cigar"))), F.lit(1))
    return d.where((F.col("contig") == contig) & (F.col("pos") < end) & (F.col("pos") + length > start))
