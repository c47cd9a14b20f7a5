import hashlib
import random
import zlib

import numpy as np

from fusewright.llm import boosting, toxicity
from fusewright.llm.common import held_out

SCHEMA = "doc_id bigint, text string, score string, held_out string"


def test_isotonic_is_the_rising_least_squares_fit():
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60)
    kx, ky = boosting.isotonic(x, y)
    assert (np.diff(ky) >= 0).all()
    v = np.unique(x)
    fitted = np.interp(v, kx, ky)
    # minimax form of the isotonic regression
    for k, value in enumerate(v):
        best = max(min(y[(x >= a) & (x <= b)].mean() for b in v[k:]) for a in v[: k + 1])
        assert abs(fitted[k] - best) < 1e-9, value


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    m = boosting.fit(x[:3000], y[:3000])
    p = m.probability(x[3000:])
    assert ((p >= 0.5) == y[3000:]).mean() > 0.95 and p.min() >= 0 and p.max() <= 1
    constant = boosting.fit(x, np.zeros(len(x)))
    assert (constant.probability(x) == 0).all()


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.3
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["snarfle", "blorg!!", "Zibzib,"]))
        rows.append((i, " ".join(t), "x", "y"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    rows += [(5000, None, "", ""), (5001, "", "", ""), (5001, "", "", ""), (None, "plain words", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, known)
    assert {"snarfle", "blorg", "zibzib"} <= set(model.lexicon)
    out = toxicity.score_column(docs, model).collect()
    assert len(out) == len(rows)
    truth = {i: y for i, _, y in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum((r.predicted == 1) == (truth[r.doc_id] == 1) for r in held) > 0.95 * len(held)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
    assert [r.score for r in toxicity.score_column(docs, toxicity.train(docs, known)).collect()] == [r.score for r in out]
    assert toxicity.score_column(docs.limit(0), model).count() == 0
    kept = toxicity.score_column(docs, model, keep=True)
    assert kept.columns == [*docs.columns, "toxic_score"] and kept.count() == len(rows)


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    flipped = known.withColumn("toxic", (known.toxic + held_out(known.doc_id).cast("int")) % 2)
    a, b = (toxicity.score_column(docs, toxicity.train(docs, k)).collect() for k in (known, flipped))
    assert a == b


def test_no_labels(spark):
    docs = spark.createDataFrame(corpus(20)[0], SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r.score for r in toxicity.score_column(docs, model).collect()} == {0.0}


def test_features_of_obfuscation():
    m = toxicity.Model({"idiot": 5.0}, boosting.fit(np.zeros((0, 18)), np.zeros(0)))
    f = dict(zip(toxicity.FEATURES, m.features("you are an 1d10t !!! s p e l l out SHOUT")))
    assert f["leet_hits"] == 1 and f["second_near"] > 0 and f["obfuscation_rate"] > 0 and f["shouted_rate"] > 0 and f["mark_rate"] > 0
    assert m.features("") == [0.0] * len(toxicity.FEATURES)


def slow_score(m, text):
    """The features by counting, the trees by walking, the calibration by looking up, one text at a time."""
    chunks = text.split()
    row = [0.0] * len(toxicity.FEATURES)
    if chunks:
        odds, leet = [], 0
        for k in chunks:
            w = k.lower().strip(toxicity.EDGES)
            o = m.lexicon.get(w)
            if o is None and w and not w.isalpha():
                plain = "".join(c for c in w.translate(toxicity.LEET) if c.isspace() or c == "_" or c.isalnum())
                o = m.lexicon.get(plain)
                leet += o is not None
            odds.append(o)
        words = [k.lower().strip(toxicity.EDGES) for k in chunks]
        hit = [i for i, o in enumerate(odds) if o is not None]
        second = [i for i, w in enumerate(words) if w in toxicity.SECOND]
        strong = sum(odds[i] >= m.strong for i in hit)
        punct = sum(not (c.isalnum() or c == "_" or c.isspace()) for k in chunks for c in k)
        runs, run = 0, 0
        for w in [*words, "xx"]:
            single = len(w) == 1 and w.isalpha()
            runs += not single and run >= toxicity.SPELLED
            run = run + 1 if single else 0
        obfuscated = sum(toxicity._OBFUSCATED.search(k) is not None for k in chunks) + runs
        n = len(chunks)
        row = [
            np.log1p(n), len(hit), len(hit) / n, len({chunks[i] for i in hit}), sum(odds[i] for i in hit), max((odds[i] for i in hit), default=0), sum(odds[i] for i in hit) / max(1, len(hit)), strong, strong / n,
            leet, len(second) / n, sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hit) / n, sum("A" <= c <= "Z" for c in text) / len(text),
            sum(len(w) > 1 and k.isupper() for k, w in zip(chunks, words)) / n, punct / len(text), sum(max(0, k.count("!") + k.count("?") - 1) for k in chunks) / n, obfuscated / n, sum(i < n / 3 for i in hit) / n,
        ]
    total = m.trees.base
    for f, c, v in zip(m.trees.feature, m.trees.cut, m.trees.value):
        i = 0
        while i < len(f):
            i = 2 * i + 1 + (row[f[i]] > c[i])
        total += v[i - len(f)]
    xs, ys = m.trees.knots
    if total <= xs[0] or total >= xs[-1]:
        return ys[0] if total <= xs[0] else ys[-1]
    k = max(i for i in range(len(xs)) if xs[i] <= total)
    return ys[k] if xs[k] == total else ys[k] + (ys[k + 1] - ys[k]) * (total - xs[k]) / (xs[k + 1] - xs[k])


def test_the_query_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)] + ["you", "du", "vous", "a", "e", "i", "o", "Hmm,", "WHAT?!", "it's", "\u00fcber"]
    bad = ["grubbel", "snarfle", "zonkish", "gr\u00fcbl"]
    hidden = ["gru66el", "sn@rfle", "z0nkish!!", "GRUBBEL", "g r u b b e l", "zooooonk"]
    rows = []
    for i in range(900):
        t = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        toxic = rng.random() < 0.4
        if toxic:
            for _ in range(rng.randint(1, 4)):
                t.insert(rng.randint(0, len(t)), rng.choice(bad + hidden))
        rows.append((i, " ".join(t), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows] + [(9000, None, "", ""), (9001, "", "", ""), (9002, "grubbel you " * 40_000, "", "")], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    texts = {i: t for i, t, _ in rows} | {9000: "", 9001: "", 9002: "grubbel you " * 40_000}
    got = toxicity.score_column(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id % 3 == 0 or r.doc_id >= 9000:
            assert abs(r.score - slow_score(model, texts[r.doc_id])) < 1e-9 if r.doc_id != 9002 else r.score > 0.5, texts[r.doc_id][:80]
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_a_very_long_first_text_stops_nothing(spark):
    rows = [(i, ("grubbel " if i % 2 else "") + f"w{i % 7} and more of it", i % 2) for i in range(300)]
    first = min((i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5), key=lambda i: __import__("hashlib").md5(str(i).encode()).hexdigest())
    rows[first] = (first, "w " * 200_000, first % 2)
    docs = spark.createDataFrame([(i, t, "", "") for i, t, _ in rows], SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int"))
    assert "grubbel" in model.lexicon
    assert "grubbel" in toxicity.train(docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int"), longest=10**9, total=5000).lexicon


def test_what_cannot_be_learnt_from_takes_no_place(spark):
    """Labels without a document, null and very long texts come first by key here; the sample is as large as what is left of it."""
    ids = sorted((i for i in range(3000) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    useless, good = ids[:300], ids[300:500]
    docs = [(i, None if k % 3 else "x " * 60) for k, i in enumerate(useless) if k % 7] + [(i, ("you vile wretch " if k % 2 else "a fine calm day ") * 3) for k, i in enumerate(good)]
    labels = [(i, 0, k % 2) for k, i in enumerate(useless)] + [(i, 0, k % 2) for k, i in enumerate(good)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), sample=200, longest=100)
    low, high = model.score(["a fine calm day " * 3, "you vile wretch " * 3])
    assert "vile" in model.lexicon and low < 0.3 < 0.7 < high
