"""Consensus sequences, peptides, reading frames and realignment: sequential work, in Arrow or grouped pandas functions."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import CODONS

c = F.col
K = 8


def pileup(bases: DataFrame) -> DataFrame:
    """bases (event_id, side, pos, base) -> event_id, side, pos, base, n, depth: the most frequent base of a position, ties by letter."""
    n = bases.groupBy("event_id", "side", "pos", "base").agg(F.count("*").alias("n"))
    return n.groupBy("event_id", "side", "pos").agg(F.max_by("base", F.struct("n", (-F.ascii("base")).alias("t"))).alias("base"), F.max("n").alias("n"), F.sum("n").alias("depth"))


def consensus(piles: DataFrame) -> DataFrame:
    """event_id, side, sequence, positions: bases in order; capitals agree by three quarters, introns are ___ and gaps of a few bases are ?."""
    letter = F.when(c("n") >= 0.75 * c("depth"), F.upper("base")).otherwise(F.lower("base"))
    g = piles.groupBy("event_id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", letter.alias("b")))).alias("x"))
    gap = lambda i: F.get("x", i)["pos"] - F.get("x", i - 1)["pos"] - 1
    parts = F.transform("x", lambda y, i: F.concat(F.when(i == 0, F.lit("")).when(gap(i) == 0, F.lit("")).when(gap(i) <= 10, F.repeat(F.lit("?"), gap(i))).otherwise(F.lit("___")), y["b"]))
    return g.select("event_id", "side", F.array_join(parts, "").alias("sequence"), F.transform("x", lambda y: y["pos"]).alias("positions"))


def fusion_transcript(five: Column, three: Column, between: Column) -> Column:
    """The two sides with a bar at the junction, or two around bases that belong to neither."""
    return F.when(F.coalesce(F.length(between), F.lit(0)) > 0, F.concat(five, F.lit("|"), F.lower(between), F.lit("|"), three)).otherwise(F.concat(five, F.lit("|"), three))


def peptide(transcript: str | None, frame: int) -> str:
    """Translates from an offset; residues of codons across the junction, or that hold mismatches, are small; a bar marks the junction; stops at * after it."""
    if not transcript or frame < 0:
        return "."
    out, codon, crossed, seen, small = [], "", False, 0, False
    bars = transcript.count("|")
    skip = frame
    for x in transcript:
        if x == "|":
            seen += 1
            if codon:
                crossed = True
            elif seen == bars:
                out.append("|")
            continue
        if x in "_[]().^$-":
            continue
        if skip:
            skip -= 1
            continue
        codon += x
        small = small or x.islower()
        if len(codon) == 3:
            aa = CODONS.get(codon.upper(), "?")
            if crossed and seen == bars:
                out.append("|")
            out.append(aa.lower() if small or crossed else aa)
            codon, crossed, small = "", False, False
            if aa == "*" and seen == bars:
                break
    return "".join(out)


def reading_frame(p: str | None) -> str:
    """in-frame, out-of-frame, stop-codon, or a dot."""
    if not p or p == "." or p.endswith("|") or "|" not in p:
        return "."
    head, _, tail = p.rpartition("|")
    stop = head.rfind("*")
    if stop >= 0 and "m" not in head[stop:].lower():
        return "stop-codon"
    if stop >= 0 and any(x.isupper() for x in head[:stop]) and not any(x.isupper() for x in head[stop:]):
        return "stop-codon"
    return "in-frame" if any(x.isupper() for x in head) and any(x.isupper() for x in tail) else "out-of-frame"


@F.pandas_udf(T.StringType())
def peptide_column(transcript: pd.Series, frame: pd.Series) -> pd.Series:
    return pd.Series([peptide(t, int(f) if f == f and f is not None else -1) for t, f in zip(transcript, frame)])


@F.pandas_udf(T.StringType())
def reading_frame_column(p: pd.Series) -> pd.Series:
    return p.map(reading_frame)


def isoform_scores(exons: DataFrame, transcribed: DataFrame) -> DataFrame:
    """exons (event_id, side, transcript_id, start, end, coding, coding_length), transcribed (event_id, side, positions, bp) -> the best transcripts.

    One point for each transcribed exonic base, one less for each that isn't between the breakpoint and the outermost one, at least 0; ten for
    a splice site at the breakpoint. Ties stay, the longest coding one first.
    """
    e = exons.join(transcribed, ["event_id", "side"])
    span = F.array_min("positions"), F.array_max("positions")
    hit = F.size(F.filter("positions", lambda p: p.between(c("start"), c("end"))))
    inside = F.greatest(F.least(c("end"), span[1]) - F.greatest(c("start"), span[0]) + 1, F.lit(0))
    bonus = F.when((c("start") == c("bp")) | (c("end") == c("bp")), 10).otherwise(0)
    s = e.groupBy("event_id", "side", "transcript_id").agg(F.greatest(F.sum(2 * hit - inside), F.lit(0)).alias("bases"), F.max(bonus).alias("bonus"), F.max("coding_length").alias("coding_length"), F.sum(c("end") - c("start") + 1).alias("length"))
    s = s.withColumn("score", c("bases") + c("bonus"))
    best = s.groupBy("event_id", "side").agg(F.max("score").alias("top"))
    kept = s.join(best, ["event_id", "side"]).where("score = top")
    order = F.struct((-c("coding_length")).alias("a"), (-c("length")).alias("b"), c("transcript_id").alias("t"))
    return kept.groupBy("event_id", "side").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]).alias("transcripts"))


@F.pandas_udf(T.StructType([T.StructField("mismatches", T.IntegerType()), T.StructField("length", T.IntegerType())]))
def mismatches(seq: pd.Series, cigar: pd.Series, forward: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Mismatches and aligned bases of segments; reference starts where the segment does. A clip away from the breakpoint, an insertion or a deletion is one."""
    import re

    op = re.compile(r"(\d+)([MIDNSHP=X])")
    out = []
    for s, g, f, r in zip(seq, cigar, forward, reference):
        ops = [(int(n), o) for n, o in op.findall(g or "")]
        k = n_aligned = i = j = 0
        for at, (n, o) in enumerate(ops):
            if o in "SH":
                i += n if o == "S" else 0
                k += not ((at == 0 and not f) or (at == len(ops) - 1 and f))
            elif o in "DN":
                k += o == "D"
                j += n
            elif o == "I":
                k += 1
                i += n
            elif o in "M=X":
                pairs = [(x, y) for x, y in zip(s[i : i + n], (r or "")[j : j + n]) if x != "N"]
                k += sum(x != y for x, y in pairs)
                n_aligned += len(pairs)
                i, j = i + n, j + n
        out.append((k, n_aligned))
    return pd.DataFrame(out, columns=["mismatches", "length"])


def kmer_index(seq: str, k: int = K) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for i in range(len(seq) - k + 1):
        out[seq[i : i + k]].append(i)
    return out


def align(read: str, gene: str, index: dict[str, list[int]], least: float, k: int = K, introns: int = 1) -> bool:
    """Whether a read aligns to a sequence: k-mer seeds are extended without gaps; one jump to a later seed, whichever of all places, stands for an intron."""
    need = int(least * len(read))

    def extend(i: int, j: int) -> tuple[int, int]:
        score = best = n = at = 0
        while i + n < len(read) and j + n < len(gene):
            score += 1 if read[i + n] == gene[j + n] else -2
            n += 1
            if score > best:
                best, at = score, n
            elif score < best - 6:
                break
        return best, at

    def walk(i: int, j: int, jumps: int) -> int:
        score, n = extend(i, j)
        best = score
        if jumps and best < need and i + n + k <= len(read):
            places = index.get(read[i + n : i + n + k], ())  # sorted
            for at in range(bisect_right(places, j + n), len(places)):
                best = max(best, score + walk(i + n, places[at], jumps - 1))
                if best >= need:
                    break
        return best

    return any(walk(i, j, introns) >= need - i for i in range(0, max(1, len(read) - need + 1)) for j in index.get(read[i : i + k], ()))


def realigned(reads: DataFrame, genes: DataFrame, least: float = 0.8) -> DataFrame:
    """reads (event_id, read_key, gene, clip), genes (gene, seq) -> event_id, bad, total: clipped parts that align to the other side's gene on either strand.

    One group is one gene: its k-mers are indexed once. Reads of 300 and more bases are passed over.
    """
    table = str.maketrans("ACGT", "TGCA")

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: Counter = Counter()
        total: Counter = Counter()
        if len(right):
            seq = right["seq"].iloc[0]
            both = [(s, kmer_index(s)) for s in (seq, seq.translate(table)[::-1])]
            for e, clip in zip(left["event_id"], left["clip"]):
                total[e] += 1
                if clip and len(clip) < 300:
                    out[e] += any(align(clip, s, ix, least) for s, ix in both)
        return pd.DataFrame([(e, out[e], n) for e, n in total.items()], columns=["event_id", "bad", "total"])

    parts = reads.groupBy("gene").cogroup(genes.groupBy("gene")).applyInPandas(judge, "event_id string, bad bigint, total bigint")
    return parts.groupBy("event_id").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))


def shared_kmers(pairs: DataFrame, genes: DataFrame, k: int = K, extension: int = 16) -> DataFrame:
    """pairs (gene1, gene2), genes (gene, seq) -> gene1, gene2, hits, length: stepped places of the smaller gene whose 16-mer the bigger one has."""
    from ..functions.sequence import kmers

    g = genes.withColumn("n", F.length("seq"))
    p = pairs.select("gene1", "gene2").distinct()
    p = p.join(g.select(c("gene").alias("gene1"), c("n").alias("n1")), "gene1").join(g.select(c("gene").alias("gene2"), c("n").alias("n2")), "gene2")
    p = p.withColumn("small", F.when(c("n1") <= c("n2"), c("gene1")).otherwise(c("gene2"))).withColumn("big", F.when(c("n1") <= c("n2"), c("gene2")).otherwise(c("gene1"))).withColumn("length", F.least("n1", "n2"))
    words = kmers(c("seq"), extension)
    stepped = g.select(c("gene").alias("small"), F.posexplode(words).alias("at", "word")).where(c("at") % k == 0)
    every = g.select(c("gene").alias("big"), F.explode(F.array_distinct(words)).alias("word"))
    hits = p.join(stepped, "small").join(every, ["big", "word"]).groupBy("gene1", "gene2", "length").agg(F.count("*").alias("hits"))
    return hits.select("gene1", "gene2", "hits", "length")
