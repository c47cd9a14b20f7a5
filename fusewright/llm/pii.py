"""Personal data: base patterns, and candidates judged by boosted trees.

Generators of high recall propose spans, which may overlap; boosted trees over features of their
format and context score them, isotonic calibration makes the scores probabilities, and a threshold
by kind, set on labelled examples for a wanted precision, selects what is redacted.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import slices, tenant

#: The base kinds, in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: No match can begin after a digit that isn't in an earlier match, so these may look behind.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, found from each @ so that long runs without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and _LOCAL.match(text[a - 1]):
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            last = m.end()
            yield a, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches that hold, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15]
    return out


#: Generators: kind and pattern, wider than the base ones (mail_words is a function). Runs are entered at their start only, so that long ones cost no more than their length.
GENERATORS = (
    ("mail_words", None),
    ("digits", re.compile(r"(?<![\w.])[+(]?[0-9](?:[ ()./-]{0,3}[0-9]){6,}(?![\w])")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("hexpairs", re.compile(r"(?<![\w:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:)(?!(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:]))(?:[0-9A-Fa-f]{1,4})?(?:::?[0-9A-Fa-f]{1,4}){2,8}(?:::)?(?![\w:])")),
)
#: A mail address in words grows from its "at": labels end before the next "at" or "dot", so no run is read twice.
_MAIL_HINT = re.compile(r"\bdot\b", re.IGNORECASE)
_AT = re.compile(r"(?i:\bat\b)|(?<=\s)@(?=\s)")
_LABEL = r"(?:(?!(?i:\b(?:at|dot)\b))[A-Za-z0-9-])"
_AFTER = re.compile(rf" ?[\])}}>]? ?{_LABEL}++(?: ?[\[({{<]? ?(?i:\bdot\b) ?[\])}}>]? ?{_LABEL}{{2,}}+)+")
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]")
#: Words before a span that speak for and against personal data.
FOR = frozenset("phone tel telephone mobile cell call fax contact reach text whatsapp email mail mailto write ssn social passport iban account card visa mastercard born dob device mac".split())
AGAINST = frozenset("version isbn order invoice ref page pages figure eq section model build serial price total sku part date year years km mb id".split())
TLDS = "com org net edu gov io de fr es it uk eu info".split()
_CONTEXT = re.compile(r"[A-Za-z]+")
FEATURES = (
    "kind", "length", "digits", "groups", "longest_group", "shortest_group", "spaces", "dashes", "dots", "brackets", "plus", "luhn", "ssn_shape", "phone_shape",
    "year_first", "distinct_digits", "for", "against", "letters", "currency", "percent", "iban_check", "colons", "dates", "bracketed", "tld",
)


def iban_check(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    s = text[a:b]
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    before = [w.lower() for w in _CONTEXT.findall(text[max(0, a - 40) : a])][-4:]
    around = text[max(0, a - 2) : a] + text[b : b + 2]
    return [
        kind, b - a, len(digits), len(groups), max(sizes), min(sizes), s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count("["), s.count("+"),
        bool(digits) and luhn(digits), sizes == [3, 2, 4], sizes in ([3, 3, 4], [3, 4], [2, 4, 4], [1, 3, 3, 4], [4, 3, 3], [2, 2, 2, 2, 2]), digits[:2] in ("19", "20") and sizes[0] == 4,
        len(set(digits)), sum(w in FOR for w in before), sum(w in AGAINST for w in before), sum(c.isalpha() for c in s), any(c in around for c in "$€£"), "%" in around,
        kind == 2 and iban_check(s), s.count(":"), sum(1900 <= int(g) <= 2040 for g in groups if len(g) == 4), sum(c in "[({<" for c in s), s[len(s.rstrip(string.ascii_letters)) :].lower() in TLDS,
    ]


def mail_words(text: str) -> Iterator[tuple[int, int]]:
    """Spans like "name at host dot com", brackets and blanks about the words allowed, in linear time."""
    last = 0
    if not _MAIL_HINT.search(text):
        return
    for m in _AT.finditer(text):
        if m.start() < last or not (after := _AFTER.match(text, m.end())):
            continue
        a = m.start()
        a -= a > last and text[a - 1] == " "
        a -= a > last and text[a - 1] in "[({<"
        a -= a > last and text[a - 1] == " "
        end = a
        while a > last and _BEFORE.match(text, a - 1):
            a -= 1
        if a < end:
            last = after.end()
            yield a, last


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(generator, start, end), overlapping ones too."""
    out = []
    for k, (kind, pattern) in enumerate(GENERATORS):
        if pattern is None:
            out += [(k, *x) for x in mail_words(text)]
            continue
        out += [(k, *m.span()) for m in pattern.finditer(text)]
    return out


def labelled_examples(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, int, int]]:
    """(text, generator, start, end, label): spans made by rule, in contexts made by rule; a bounded labelled sample."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvwy") for _ in range(rng.randint(2, 9)))

    def iban() -> str:
        body = d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        s = f"DE{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, 22, 4)) if rng.random() < 0.5 else s

    def card() -> str:
        s = rng.choice("3456") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        return rng.choice([s, "-".join(s[i : i + 4] for i in range(0, 16, 4)), " ".join(s[i : i + 4] for i in range(0, 16, 4))])

    at, dot = lambda: rng.choice(["at", "at", "AT", "At"]), lambda: rng.choice(["dot", "dot", "DOT", "Dot"])

    yes = (
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(4)} {d(3)}", card, iban,
        lambda: f"{word()}.{word()} {at()} {word()} {dot()} {rng.choice(TLDS)}", lambda: f"{word()}{rng.choice(['', '_', '.', '-'])}{word()} [{at()}] {word()} [{dot()}] {rng.choice(TLDS)}", lambda: f"{word()}{d(2)} ({at()}) {word()} ({dot()}) {word()} ({dot()}) {rng.choice(TLDS)}",
        lambda: f"{word()} {at()} {word()} {dot()} {rng.choice(TLDS)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}", lambda: f"0{d(3)}/{d(6)}", lambda: " ".join(["0" + d(1), *(d(2) for _ in range(4))]), lambda: f"00{d(2)} {d(3)} {d(7)}",
        lambda: ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)), lambda: f"{rng.choice(['2001:db8', '2a02:26f0', 'fe80'])}::{rng.randrange(16, 65536):x}:{rng.randrange(16, 65536):x}", lambda: ":".join(rng.choice("0123456789abcdef") + rng.choice("0123456789ABCDEF") for _ in range(6)),
    )
    no = (
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: d(rng.randint(7, 19)),
        lambda: f"{d(1)}.{d(2)}.{d(1)}.{d(4)}", lambda: f"{d(4)} {d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{rng.randint(1, 999)}.{d(8)}", lambda: f"{d(2)}-{d(2)}-{d(4)}",
        lambda: " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(4, 8))), lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"look at {word()} dot {word()}", lambda: f"the {word()} at the dot matrix", lambda: f"{rng.randint(1, 23)}:{d(2)}:{d(2)}", lambda: ":".join(d(rng.randint(1, 2)) for _ in range(rng.randint(3, 5))), lambda: d(rng.randint(20, 60)), lambda: f"{d(2)}/{d(2)}/{rng.randint(1900, 2030)}", lambda: f"GB{d(2)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{d(6)}-{d(6)}", lambda: f"{d(2)}.{d(2)}.{rng.randint(1900, 2030)}",
    )
    out = []
    for i in range(n):
        label = int(rng.random() < 0.5)
        s = rng.choice(yes if label else no)()
        hint = rng.random()
        cue = rng.choice(sorted(FOR if label else AGAINST)) if hint < 0.5 else rng.choice(sorted(AGAINST if label else FOR)) if hint < 0.53 else word()
        head = f"{word()} {word()} {cue}{rng.choice([' ', ': ', ' # '])}"
        text = head + s + f" {word()} {word()}"
        best = max(((min(b, len(head) + len(s)) - max(a, len(head)), -(b - a), k, a, b) for k, a, b in candidates(text)), default=(0,))
        if best[0] > 0:
            out.append((text, *best[2:], label))
    return out


@dataclass
class Model:
    trees: boosting.Boosted
    thresholds: list[float]

    def spans(self, text: str, taken: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Selected candidates that touch no base span; of two that overlap the likelier, then the longer, then the first."""
        free = Places((a, b) for _, a, b in taken)
        found = [c for c in candidates(text) if not free.touched(*c[1:])]
        if not found:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in found], float))
        out: list[tuple[str, int, int]] = []
        own = Places(())
        for x, (k, a, b) in sorted(zip(p.tolist(), found), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
            if x >= self.thresholds[k] and not own.touched(a, b):
                own.add(a, b)
                out.append((GENERATORS[k][0], a, b))
        return out


class Places:
    """Places of a text that are taken, as intervals apart from each other, by start."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touched(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        """An interval that touches none."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def learn(examples: Sequence[tuple[str, int, int, int, int]] | None = None, precision: float = 0.97) -> Model:
    """Trees of the labelled spans, and for each generator the least threshold with the wanted precision on the later third."""
    rows = list(examples or labelled_examples())
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r[4] for r in rows])
    cut = len(rows) * 2 // 3
    trees = boosting.fit(x[:cut], y[:cut], trees=80, depth=4, rate=0.15)
    p, k, y = trees.probability(x[cut:]), x[cut:, 0], y[cut:]
    thresholds = []
    for g in range(len(GENERATORS)):
        own = k == g
        options = [t for t in np.unique(p[own]).tolist() if t >= 0.5 and y[own & (p >= t)].mean() >= precision]
        thresholds.append(min(options, default=2.0))
    return Model(trees, thresholds)


def all_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and these with the method's own, by kind as listed, then start."""
    base = base_spans(text)
    names = [*KINDS, *(k for k, _ in GENERATORS)]
    return base, sorted(base + model.spans(text, base), key=lambda s: (names.index(s[0]), s[1]))


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, model: Model) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the union."""
    out, at = [], 0
    for kind, a, b in sorted(all_spans(text, model)[1], key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, counts of the base kinds, base_sha256, spans.

    Null and empty texts have no spans. Whole texts are scanned, however long, in linear time. Spans may overlap; those
    that begin at one place go by kind as listed, and of one kind's candidates the first one counts. Repeated rows give
    equal results; null doc_id stays null. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or learn())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("pii")
        for b in slices(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                base, every = all_spans(t or "", sent.value)
                n = [sum(k == x for k, _, _ in base) for x in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
