"""Read-level steps on single rows: each holds, doesn't hold, or meets a row that was discarded before."""

import random

import pytest
from pyspark.sql import functions as F

from fusewright.functions import cigar
from fusewright.operators import fate
from fusewright.operators import read_filters as rf

c = F.col
BASE = {
    "read_key": "r", "is_split": False, "fate": "none", "at_splice_site": False, "fw_gene_end": 100, "rv_gene_start": 90_000,
    **{f"{p}_{k}": v for p in ("m1", "m2", "sp") for k, v in {"contig": "1", "start": 1000, "end": 1049, "strand": True, "cigar": "50M", "seq": "ACGTTGCAAG" * 5, "genes": [1]}.items()},
}
PAIR = {"m2_strand": False, "m2_start": 50_000, "m2_end": 50_049, "m2_genes": [2]}
SPLIT = {"is_split": True, "m1_strand": True, "m1_start": 900, "m1_end": 949, "m2_strand": False, "m2_start": 1000, "m2_end": 1029, "m2_cigar": "30M20S", "sp_strand": False, "sp_start": 60_000, "sp_end": 60_019, "sp_cigar": "30S20M", "sp_genes": [2]}


def rows(spark, *changes):
    types = {bool: "boolean", int: "int", str: "string", list: "array<bigint>"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in BASE.items())
    df = spark.createDataFrame([tuple((BASE | x)[k] for k in BASE) for x in changes], schema)
    return df.withColumns({f"{p}_ops": cigar.parse(c(f"{p}_cigar")) for p in ("m1", "m2", "sp")})


CASES = [
    (rf.read_through, PAIR | {"rv_gene_start": 5000}, PAIR | {"fw_gene_end": 2000, "rv_gene_start": 50_000}),
    (rf.inconsistently_clipped, SPLIT | {"m1_end": 1033}, SPLIT | {"m1_end": 1032}),
    (rf.homopolymer, SPLIT | {"m2_seq": "ACGTTGCAAG" * 3 + "AAAAAACGTTACGTTACGTT"}, SPLIT),
    (rf.small_insert_size, PAIR | {"m2_start": 1005}, PAIR | {"m2_start": 1006}),
    (rf.long_gap, SPLIT | {"m1_cigar": "12M832512N13M25S"}, SPLIT | {"m1_cigar": "16M832512N13M25S"}),
    (rf.same_gene, PAIR | {"m2_genes": [1, 2]}, PAIR),
    (rf.hairpin, PAIR | {"m2_start": 1020, "m2_end": 1069}, PAIR),
]


@pytest.mark.parametrize("step,bad,good", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_step(spark, step, bad, good):
    d = rows(spark, bad, good, bad | {"fate": "duplicates"})
    assert [r.fate for r in fate.discard(d, "x", step()).collect()] == ["x", "none", "duplicates"]


def test_first_fate_wins(spark):
    d = fate.discard_all(rows(spark, PAIR | {"m2_start": 1005}, PAIR), [("a", F.lit(None).cast("boolean")), ("b", rf.small_insert_size()), ("c", rf.small_insert_size())])
    assert [r.fate for r in d.collect()] == ["b", "none"]
    assert [r.fate for r in fate.recover(d, ["b"], F.lit(True)).collect()] == ["none", "none"]


def test_duplicates(spark):
    d = rows(spark, PAIR | {"read_key": "b"}, PAIR | {"read_key": "a"}, PAIR | {"read_key": "c", "m1_start": 1002, "m1_cigar": "2S48M"}, PAIR | {"read_key": "d", "m1_start": 1001})
    key = ["contig1", "contig2", "pos1", "pos2"]
    got = {r.read_key: r.fate for r in rf.mark_duplicates(rf.duplicate_key(d), key).collect()}
    assert got == {"a": "none", "b": "duplicates", "c": "duplicates", "d": "none"}


def test_low_entropy(spark):
    low = {"m1_seq": "ACG" * 16 + "AC"}
    tandem = SPLIT | low | {"m2_strand": True, "sp_strand": True, "m2_start": 1000, "sp_end": 1050}
    d = rows(spark, PAIR | low, PAIR, SPLIT | low | {"fate": "hairpin"}, tandem | {"fate": "hairpin"}, tandem | {"fate": "duplicates"})
    assert [r.fate for r in rf.filter_low_entropy(d).collect()] == ["low_entropy", "none", "hairpin", "low_entropy", "duplicates"]


def test_mismatch_probability(spark):
    d = spark.createDataFrame([(0, 50), (1, 50), (6, 50), (1, 15), (0, 15)], "k int, n int")
    p = [r[0] for r in d.select(rf.binomial_point(c("k"), c("n"), 0.01)).collect()]
    assert abs(p[0] - 0.99**50) < 1e-12 and abs(p[1] - 50 * 0.01 * 0.99**49) < 1e-12
    assert [r[0] for r in d.select(rf.too_many_mismatches(c("k"), c("n"))).collect()] == [False, False, True, True, False]


def test_most_frequent_word_by_brute_force(spark):
    """From the left, without overlaps, the last word left out; equal calls are one, whatever asks for them."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTNx\u00e9\U0001f600"[:n]) for _ in range(rng.randrange(40))) for n in (1, 2, 4, 8) for _ in range(40)] + ["", None, "A" * 9, "ATATATATA"]

    def most(s, k):
        s = "".join(x if x in "TGC" else "A" for x in s or "")[:-1]
        return max((s.count(s[i : i + k]) for i in range(len(s) - k + 1)), default=0)

    d = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    for k in (2, 3, 5):
        assert {r.i: r.m for r in d.select("i", rf.low_entropy_counts(c("s"), k).alias("m")).collect()} == {i: most(s, k) for i, s in enumerate(texts)}
    plan = d.select(rf.low_entropy_counts(c("s")), rf.low_entropy(c("s")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("counted(s") == 1 or plan.count("[counted(") == 1
