import hashlib
import random
import re
import time

import numpy as np

from fusewright.llm import pii

SCHEMA = "doc_id bigint, text string, spans string, n_ip int"


def base(text):
    """The contract's patterns, word for word."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    return out


TEXTS = [
    None, "", "a@b@c.d e.f@x.y.z, q@w", "1.2.3.4.5 300.1.1.1 0001.2.3.255 1.2.3 10.0.0.1.", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111", "+1 (743) 555-3824 12 +12 +123456789012345678",
    "call (743) 555-3824 now", "john.doe at mail dot com", "in 1999-2004 or 2021-11-26, version 1.20.3.4000", "é a@é.com x@y-.z \U0001f600 b@c.d", "9" * 3000 + "." + "a" * 50_000 + "@b.c",
]


def test_scan(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], "", 0)] * 2
    out = pii.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = base(TEXTS[5 if r.doc_id is None else r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)} >= set(want)
    by = {r.doc_id: r.spans for r in out}
    assert by[6] == "digits:5:19" and by[7] == "mail_words:0:24" and by[8] == ""
    assert pii.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_base_spans_on_random_texts():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "b@", "@", ".", "1", "25", "411", "+", " ", "-", "(", ")", "x.y", "0", "\n", "é"]) for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == base(t), t


def test_held_out_examples():
    m = pii.learn()
    new = pii.labelled_examples(1500, seed=123)
    hit = [(bool(m.spans(t, [])), y) for t, _, _, _, y in new]
    tp, fp, fn = (sum(h == a and y == b for h, y in hit) for a, b in ((True, 1), (True, 0), (False, 1)))
    assert tp / (tp + fp) > 0.93 and tp / (tp + fn) > 0.8


#: Written by hand, not by the training templates.
PERSONAL = [
    "Ring me on (020) 7946 0958 tomorrow", "write to john.doe At mail Dot com please", "jane_doe [AT] example [DOT] org", "server 2001:db8::ff00:42:8329 answered", "SSN: 078-05-1120",
    "call 555-867-5309 now", "IBAN GB82 WEST 1234 5698 7654 32 is mine", "mac 00:1A:2B:3C:4D:5E seen", "tel. 030/1234567", "Telefon 0171 2345678 bitte", "from fe80::1ff:fe23:4567:890a", "ring 01 23 45 67 89",
    "mail: sam (at) post (dot) co (dot) uk",
]
CLEAN = [
    "ISBN 978-3-16-148410-0", "Version 10.15.7.1234567", "between 2021-03-04 and 2022-05-06", "order 1234567890", "12:30:45 sharp", "look at the dot on the page", "population 1 234 567 890",
    "build 20240131235959", "pages 100-200, 300-400", "ratio 1:2:3:4", "1914-1918 and 1939-1945", "we met at noon dot dot dot", "a score of 3:2", "sum 1,000,000.00 in total", "part 0000000000000001",
]


def test_texts_not_of_the_templates():
    m = pii.learn()
    assert all(pii.candidates(t) for t in PERSONAL)
    assert sum(bool(m.spans(t, [])) for t in PERSONAL) >= 11 and sum(bool(m.spans(t, [])) for t in CLEAN) <= 1


def slow_spans(m, text, taken):
    """Selected spans by comparing each candidate with all spans."""
    out = []
    free = [c for c in pii.candidates(text) if not any(a < c[2] and c[1] < b for _, a, b in taken)]
    scored = [(float(m.trees.probability(np.array([pii.features(text, *c)], float))[0]), c) for c in free]
    for p, (k, a, b) in sorted(scored, key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
        if p >= m.thresholds[k] and not any(a < e and s < b for _, s, e in out):
            out.append((pii.GENERATORS[k][0], a, b))
    return out


def test_method_spans_by_brute_force():
    m = pii.learn()
    rng = random.Random(6)
    pieces = PERSONAL + CLEAN + ["a@b.com", "+1 (743) 555-3824", "1.2.3.4", "4111 1111 1111 1111", "2001:db8::1 00:1A:2B:3C:4D:5E"]
    for _ in range(60):
        text = rng.choice([" ", ", ", "-", ""]).join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))
        base = pii.base_spans(text)
        assert m.spans(text, base) == slow_spans(m, text, base)
    text = " ".join("a@b.com call 555-867-5309 now" for _ in range(4000))
    assert len(pii.all_spans(text, m)[1]) == 8000


def test_redacted():
    m = pii.learn()
    assert pii.redacted("write a@b.c or +1 (743) 555-3824.", m) == "write [email] or [phone]."
    assert pii.redacted("clean", m) == "clean"


def test_long_runs_are_linear():
    model = pii.learn()
    for text in ("a" * 1_000_000 + " at foo dot com", "x" + "-at-b" * 200_000 + " dot com", "-at-b" * 200_000, "a at " * 200_000 + "b dot com", "1 " * 500_000 + "x"):
        began = time.time()
        pii.all_spans(text, model)
        assert time.time() - began < 6
    assert [text[a:b] for text in ["write jane [at] mail (dot) example dot org now"] for a, b in pii.mail_words(text)] == ["jane [at] mail (dot) example dot org"]
    assert list(pii.mail_words("x-at-y-at-b dot com")) == [(0, 19)]
