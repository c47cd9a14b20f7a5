import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fusewright.llm import fim

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")
ALPHABET = st.text(st.sampled_from("abZ <>PSM1é\n漢\U0001f600ſK"), max_size=60)


def brute(doc_id, text):
    tokens = TOKEN.findall(text)
    n = len(tokens)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10**9), ALPHABET)
def test_same_as_tokens(doc_id, text):
    assert fim.transform(doc_id, text) == brute(doc_id, text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**200))
def test_ranked(bits):
    width = max(1, bits.bit_length())
    places = [i for i in range(width) if bits >> i & 1]
    assert [fim.ranked(bits, width, k) for k in range(len(places) + 1)] == places + [width]


def test_rows(spark):
    rng = random.Random(5)
    texts = ["", None, "a", " ", "<P> x", "a<", "<S", "<M>", "x" * 300_000, "ab1 " * 100_000, "é" * 50_000 + "\U0001f600b"]
    texts += ["".join(rng.choice("ab <>PSM\né") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b c d", "y", 2), (7, "a b", "z", 3), (7, "a b", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, output string, n int")
    made = fim.fill_in_middle(df)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *brute(i, t or ""), t or "") for i, t, _, _ in rows]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
