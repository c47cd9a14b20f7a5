import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from fusewright.llm import media, mixing, urlfilter

DOCS = "doc_id bigint, text string, source string, size string, target string, key string"


def level(sizes, weights, budget, cap):
    """Targets by sharing the excess again and again."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if target[i] + left * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] += left * weights[i] / w
            break
        gone = sum(cap * sizes[i] for i in over)
        for i in over:
            target[i] = cap * sizes[i]
        open_ -= over
        left = budget - sum(target[i] for i in range(len(sizes)) if i not in open_)
        for i in open_:
            target[i] = 0.0
    return target


def test_mix(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 5}", "x", "y", "z") for i in range(300)]
    rows += [(i, "w " * 50, None, "x", "y", "z") for i in range(300, 330)]
    rows += [(5, None, "s0", "", "", ""), (None, "a b", "s1", "", "", ""), (7, "a b c", "s9", "", "", ""), (7, "a b c", "s9", "", "", ""), (8, "", "s99", "", "", "")]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sources]
    goal = dict(zip(sources, level(sizes, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5 * sum(sizes), 2)))
    for s, size in zip(sources, sizes):
        own = [r for r in out if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert abs(own[0].target - goal[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - goal[s]) < 1
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_urls(spark):
    cases = {
        "http://WWW.Example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://m.example.com/en/?a": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://my-example.com/en/": ("my-example.com", "/en/", "com/", "allow"),
        "https://a.b.net/fr/1#x": ("a.b.net", "/fr/1", "net/fr/", "block"),
        "https://a.b.net/fr": ("a.b.net", "/fr", None, "allow"),
        "https://example.com": ("example.com", "", None, "allow"),
        "ftp://com?x://net/es/": ("com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h", "host") for i, u in enumerate(cases)], "page_id bigint, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df.unionAll(df)).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert "Python" not in urlfilter.judge(df)._jdf.queryExecution().toString()
    many = [urlfilter.Rule("block", f"h{i}.org", "/") for i in range(300)]
    df = df.select("page_id", F.concat(F.lit("http://a.h"), F.col("page_id"), F.lit(".org/")).alias("url"))
    assert {r.rule for r in urlfilter.judge(df, many).collect()} == {f"h{i}.org/" for i in range(len(cases))}
    many = [urlfilter.Rule("block", f"h{i}.org", "/") for i in range(30_000)]
    assert {r.rule for r in urlfilter.judge(df, many).collect()} == {f"h{i}.org/" for i in range(len(cases))}


def slow_judge(host, path, rules):
    """By trying every rule, without regular expressions."""
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(((-len(r.name), r.name, r.verdict) for r in fits), default=(0, None, "allow"))[1:]


def test_rules_as_a_table(spark):
    rng = np.random.default_rng(2)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x-y.net", "org"], ["/", "/a", "/a/", "/a/b", "/%41", ""]
    rules = [urlfilter.Rule(str(rng.choice(["allow", "block"])), h, p) for h in hosts[1:] for p in paths[:5] if rng.random() < 0.6] + [urlfilter.Rule("block", "a.com", "")]
    urls = [f"http://{rng.choice(['', 'w.', 'w.b.', 'x-'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'a', '/b/c', '?q'])}" for _ in range(600)] + ["http://a.com/" + "a/" * 30_000]
    df = spark.createDataFrame([(i, u, "n") for i, u in enumerate(urls + [None, ""])], "page_id bigint, url string, place string")
    one, two = urlfilter.judge(df, rules).collect(), urlfilter.judge(df, rules, in_plan=0).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == len(urls) + 2
    assert [r for r in one if (r.rule, r.verdict) != slow_judge(r.host, r.path, rules)] == []


def test_media(spark):
    texts = ["", None, "a", "é" * 500, "The same text. " * 400, "The same text. " * 400, "x" * 192]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, feature int")
    full = {r.doc_id: r for r in media.media_column(df).collect()}
    out = {r.doc_id: r for r in media.media_digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        size = max(192, -(-len(raw) // 192) * 192)
        payload = raw.ljust(size)
        assert media.read(bytes(full[i].media)) == payload
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), size, hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes) == (zlib.crc32(payload[-16:]), len(full[i].media))
        assert r.media_sha256 == hashlib.sha256(bytes(full[i].media)).hexdigest()
        assert r.n_pairs == len(full[i].fingerprint)
    assert out[4].feature == out[5].feature != out[3].feature
    assert media.media_digest(df.limit(0)).count() == 0


def slow_fingerprint(payload):
    """By the transform's definition, maxima and pairs one by one."""
    x = [b - 128.0 for b in payload] + [0.0] * media.WINDOW
    n = media.WINDOW
    waves = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    frames = []
    for a in range(0, len(payload), media.STEP):
        power = np.abs(waves @ np.array([x[a + i] * window[i] for i in range(n)]))
        tops = [(power[k], -k) for k in range(1, n // 2) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
        frames.append([-k for _, k in sorted(tops, reverse=True)[: media.PEAKS]])
    return sorted((t, (f << 12) | (g << 2) | gap) for t in range(len(frames)) for gap in range(1, media.REACH + 1) if t + gap < len(frames) for f in frames[t] for g in frames[t + gap])


def test_fingerprints_by_definition(spark):
    texts = ["Some prose, not long at all. " * 30, "b" * 100 + "a?! " * 200, "\u4e2d\u6587 und \xe4\xf6\xfc " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in media.media_digest(df).collect():
        want = slow_fingerprint(media.payload_of(texts[r.doc_id])[1])
        assert [(x.time, x.code) for x in r.fingerprint] == want
        flat = np.array([t for t, _ in want], "<i4").tobytes() + np.array([k for _, k in want], "<i4").tobytes()
        assert r.feature == hashlib.sha256(flat).hexdigest()


def test_peaks_of_a_tone():
    t = np.arange(192 * 50)
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.WINDOW)).astype(np.uint8).tobytes()
    assert (media.peaks(tone)[1:-2, 0] == 40).all()
    times, codes = media.fingerprint(tone)
    assert (np.diff(times) >= 0).all() and len(times) == len(codes) > 0
