"""BAM files against SAM files of the same records, cut at any byte."""

import random
import re
import struct
import time
import zlib

import pytest

from fusewright.plans import detect
from fusewright.sources import bam, text

from tests.test_detect import files, seq  # noqa: F401


def record(qname, flag, ref, pos, ops, bases, tags=b"", mate=-1, mate_pos=-1):
    codes = b"".join(struct.pack("<I", n << 4 | bam.OPS.index(o)) for n, o in ops)
    q = [bam.SEQ.index(x) for x in bases] + [0] * (len(bases) % 2)
    packed = bytes(a << 4 | b for a, b in zip(q[::2], q[1::2]))
    name = qname.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, len(ops), flag, len(bases), mate, mate_pos, 0) + name + codes + packed + b"\xff" * len(bases) + tags
    return struct.pack("<i", len(body)) + body


def block(data):
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def head(contigs):
    data = b"BAM\1" + struct.pack("<ii", 0, len(contigs))
    return data + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in contigs)


def bgzf(data, size):
    return b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b"")


def of_sam(sam):
    """BAM bytes of SAM text; contigs without a header line have a length of 1,000,000."""
    lines = [x.split("\t") for x in sam.splitlines()]
    told = {x[1][3:]: int(x[2][3:]) for x in lines if x[0] == "@SQ"}
    lines = [x for x in lines if not x[0].startswith("@")]
    for x in lines:
        for n in (x[2], x[6]):
            if n not in "*=":
                told.setdefault(n, 1_000_000)
    at = {n: i for i, n in enumerate(told)} | {"*": -1}
    out = []
    for x in lines:
        tags = b"".join((t[:2].encode() + b"Z" + t[5:].encode() + b"\0") if t[3] == "Z" else t[:2].encode() + b"i" + struct.pack("<i", int(t[5:])) for t in x[11:])
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", x[5])]
        mate = at[x[2]] if x[6] == "=" else at[x[6]]
        out.append(record(x[0], int(x[1]), at[x[2]], int(x[3]) - 1, ops, "" if x[9] == "*" else x[9], tags, mate, int(x[7]) - 1))
    return head(list(told.items())), out


def random_sam(n, seed=1):
    rng = random.Random(seed)
    out = ["@SQ\tSN:chr1\tLN:400000\n@SQ\tSN:chrM\tLN:400000"]
    for i, at in enumerate(sorted(rng.randrange(1, 390_000) for _ in range(n))):
        k = rng.randrange(20, 3000 if i % 97 == 0 else 120)
        clip = rng.randrange(0, 10)
        ops = f"{k - clip}M" + (f"{clip}S" if clip else "") if i % 3 else f"{k - 10}M{rng.randrange(1, 30_000 if i % 9 == 0 else 500)}N10M"
        tags = ["NM:i:3", f"HI:i:{rng.randrange(1, 9)}"] * (i % 2) + ["SA:Z:chr1,5"] * (i % 5 == 0)
        out.append("\t".join([f"r{i}", str(rng.choice([65, 129, 16, 0])), "chr1" if i < n * 0.8 else "chrM", str(at), "60", ops, rng.choice("=*"), str(rng.randrange(1, 9)), "0", "".join(rng.choice("ACGTN") for _ in range(k)), "*", *tags]))
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("size", [60_000, 700])
def test_any_cut_gives_the_rows_of_sam(spark, tmp_path, size):
    sam = random_sam(1500)
    top, recs = of_sam(sam)
    (tmp_path / "a.sam").write_text(sam)
    (tmp_path / "a.bam").write_bytes(bgzf(top + b"".join(recs), size))
    want = sorted(map(str, text.sam(spark, str(tmp_path / "a.sam")).collect()))
    whole = (tmp_path / "a.bam").stat().st_size
    for split in (1 << 20, whole // 3, whole // 11, whole // 40):
        d = bam.bam(spark, str(tmp_path / "a.bam"), split)
        assert d.rdd.getNumPartitions() >= whole // split
        assert sorted(map(str, d.collect())) == want
    assert sorted(map(tuple, bam.contig_lengths(spark, str(tmp_path / "a.bam")).collect())) == [("1", 400_000), ("MT", 400_000)]


def test_plain_gzip_folders_and_broken_files(spark, tmp_path):
    sam = random_sam(300, 2)
    top, recs = of_sam(sam)
    data = top + b"".join(recs)
    cut = len(data) // 2
    z = [(lambda o, x: o.compress(x) + o.flush())(zlib.compressobj(wbits=31), x) for x in (data[:cut], data[cut:])]
    d = tmp_path / "many"
    d.mkdir()
    (d / "a.bam").write_bytes(b"".join(z))
    (d / "b.bam").write_bytes(bgzf(data, 5000))
    (d / "c.bam").write_bytes(bgzf(top, 5000))
    assert bam.bam(spark, str(d), 4000).count() == 600
    (tmp_path / "cut.bam").write_bytes(bgzf(data[:-7], 5000))
    with pytest.raises(Exception, match="truncated"):
        bam.bam(spark, str(tmp_path / "cut.bam")).count()
    (tmp_path / "no.bam").write_bytes(bgzf(b"CRAM" * 9, 5000))
    with pytest.raises(Exception, match="no BAM file"):
        bam.bam(spark, str(tmp_path / "no.bam")).count()


def test_a_region_reads_its_blocks_only(spark, tmp_path):
    sam = random_sam(3000, 3)
    top, recs = of_sam(sam)
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(packed := bgzf(top + b"".join(recs), 2000))
    ix = bam.index(spark, path, 50_000, 4000).cache()
    for a, b in ((50_000, 50_500), (0, 20_000), (200_000, 240_000), (399_000, 400_000)):
        length = lambda g: max(1, sum(int(n) for n, o in re.findall(r"(\d+)([MDN])", g)))
        want = sorted(str(r) for r in text.sam(spark, _sam(tmp_path, sam)).collect() if r.contig == "1" and r.pos < b and r.pos + length(r.cigar) > a)
        chunks = bam.chunks_of(ix, "1", a, b, 0)
        spoilt = bytearray(b"\xee" * len(packed))
        keep(spoilt, packed, 0, 0)
        for _, first, last in chunks:
            keep(spoilt, packed, first >> 16, last >> 16)
        (tmp_path / "a.bam").write_bytes(spoilt)  # all blocks but those named can't be read now
        assert sorted(map(str, bam.region(spark, path, ix, "1", a, b, 0).collect())) == want
        assert sum((last >> 16) - (first >> 16) for _, first, last in chunks) < len(packed) / 3


def keep(spoilt, packed, first, last):
    """The blocks from first to last, and as many as the last one's last record reaches into."""
    stop = last
    for _ in range(4):
        stop += bam.block_size(packed[stop : stop + 64]) or 0
    spoilt[first:stop] = packed[first:stop]


def test_bai(spark, tmp_path):
    top, recs = of_sam(random_sam(500, 4))
    path = str(tmp_path / "a.bam")
    (tmp_path / "a.bam").write_bytes(bgzf(top + b"".join(recs), 3000))
    own = sorted(map(tuple, bam.index(spark, path).collect()))
    names = ["chr1", "chrM"]
    out = b"BAI\1" + struct.pack("<i", 2)
    for n in names:
        bins, windows = [r for r in own if r[1] == n and r[2] == "bin"], {r[3]: r[4] for r in own if r[1] == n and r[2] == "window"}
        out += struct.pack("<i", len(bins) + 1) + b"".join(struct.pack("<IiQQ", r[3], 1, r[4], r[5] + 1) for r in bins) + struct.pack("<IiQQQQ", 37450, 2, 1, 2, 3, 4)
        out += struct.pack("<i", max(windows) + 1) + b"".join(struct.pack("<Q", windows.get(i, 0)) for i in range(max(windows) + 1))
    (tmp_path / "a.bam.bai").write_bytes(out)
    assert sorted(map(tuple, bam.bai(spark, str(tmp_path / "a.bam.bai"), path).collect())) == own


def _sam(tmp_path, sam):
    (tmp_path / "r.sam").write_text(sam)
    return str(tmp_path / "r.sam")


def test_detect_on_sam_and_bam(spark, files, tmp_path):  # noqa: F811
    head_ = "@SQ\tSN:1\tLN:20000\n@SQ\tSN:2\tLN:30000\n@SQ\tSN:AC_000001\tLN:3000\n"
    pair = "".join(f"w{i}\t65\t1\t{1700 + i}\t60\t50M\tAC_000001\t{101 + i % 4}\t0\t{seq(50, i % 40)}\t*\nw{i}\t145\tAC_000001\t{101 + i % 4}\t60\t50M\t1\t{1700 + i}\t0\t{seq(50, i % 31 + 3)}\t*\n" for i in range(40))
    sam = head_ + (files / "a.sam").read_text() + pair
    (tmp_path / "v.sam").write_text(sam)
    top, recs = of_sam(sam)
    (tmp_path / "v.bam").write_bytes(bgzf(top + b"".join(recs), 3000))
    a, b = (detect.detect(spark, str(tmp_path / f"v.{k}"), str(files / "a.gtf")).collect() for k in ("sam", "bam"))
    assert sorted(map(str, a)) == sorted(map(str, b)) and any("viral" in r.fate for r in b)


def test_time_is_linear(spark, tmp_path):
    top, recs = of_sam(random_sam(4000, 5))
    body = bgzf(b"".join(recs), 60_000)[: -len(block(b""))]
    took = []
    for times in (4, 16):
        with open(tmp_path / "big.bam", "wb") as f:
            f.write(block(top))
            for _ in range(times):
                f.write(body)
            f.write(block(b""))
        began = time.time()
        assert bam.bam(spark, str(tmp_path / "big.bam"), 1 << 20).count() == 4000 * times
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5
