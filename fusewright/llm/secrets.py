"""Secret scans: base patterns, and formats learnt by grammar inference.

For each credential format a probabilistic automaton is inferred from labelled examples by merging
statistically compatible states of their prefix tree; one more is inferred from strings that are no
credentials. Every candidate is scored by how much likelier its best format is: each run of key
letters and signs of any length, and, where a run as a whole doesn't pass, its parts.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import automata
from .common import numbered, slices, tenant

#: The base kinds, in order, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run shorter than asked fails wherever it is begun, so the least lengths can stand in the patterns.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Parts of a run lie between path signs, or between repeated signs.
_PART = re.compile(r"(?:(?!([-_.=+/])\1)[A-Za-z0-9+_-])+")
#: Runs that a worker remembers not to pass, the longest of them.
REMEMBERED, SHORT = 300_000, 64
#: Symbols of the automata: digits, letters that are hexadecimal digits, other letters; signs stay.
_CLASSES = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U")})
#: Characters of a head that is common to a format.
HEAD = 3
#: Log likelihood ratio that a candidate needs, in all and by character.
LEAST, LEAST_EACH = 10.0, 0.4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled_examples(n: int = 240, seed: int = 5) -> dict[str, list[str]]:
    """Labelled credentials by format and, under "", strings that are none: made by rule from public formats."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: pick(string.ascii_lowercase, rng.randint(2, 9))
    number = lambda: pick(string.digits, rng.randint(1, 6))
    short = lambda k=3: rng.choice([str.lower, str.upper])(pick(string.ascii_lowercase, rng.randint(1, k)))
    formats = {
        "hexkey": lambda: pick(hexa, rng.choice([32, 40, 48, 64])),
        "accesskey": lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + "234567", 16),
        "prefixed": lambda: rng.choice(["ghp_", "gho_", "glpat-", "sk_live_", "pk_test_", "npm_"]) + pick(alnum, rng.choice([20, 24, 36])),
        "chat": lambda: f"xox{rng.choice('bap')}-{pick(string.digits, 12)}-{pick(string.digits, 12)}-{pick(alnum, 24)}",
        "mapkey": lambda: "AIza" + pick(alnum + "_-", 35),
        "base64": lambda: pick(b64, rng.choice([27, 38, 40, 43, 62, 86])) + rng.choice(["", "=", "=="]),
        "jwt": lambda: ".".join(["eyJ" + pick(alnum, rng.randint(17, 33)), "eyJ" + pick(alnum + "_-", rng.randint(30, 90)), pick(alnum + "_-", 43)]),
    }
    clean = (
        lambda: word() + pick(string.ascii_lowercase, rng.randint(10, 30)),
        lambda: "-".join(word() for _ in range(rng.randint(3, 7))),
        lambda: "_".join(word() for _ in range(rng.randint(3, 7))) + rng.choice(["", pick(string.digits, rng.randint(1, 4))]),
        lambda: "/".join(word() for _ in range(rng.randint(3, 7))) + rng.choice(["", ".html", f"/{rng.randint(1, 99999)}"]),
        lambda: ".".join(word() for _ in range(rng.randint(2, 5))) + rng.choice(["", f".{rng.randint(0, 99)}"]),
        lambda: f"//{word()}.{word()}.com/{word()}/{rng.randint(1, 99999)}",
        lambda: f"{word()}{rng.randint(1, 9999)}.{word()}.{word()}",
        lambda: f"{rng.randint(1000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 30)}T{pick(string.digits, 6)}",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(rng.randint(4, 6))),
        lambda: pick(string.digits, rng.randint(16, 24)),
        lambda: "-".join(pick(string.digits, rng.randint(2, 5)) for _ in range(rng.randint(3, 6))),
        lambda: rng.choice("=-_.") * rng.randint(16, 60),
        lambda: word().title() + "".join(word().title() for _ in range(rng.randint(2, 5))) + rng.choice(["", str(rng.randint(0, 9))]),
        lambda: pick(string.ascii_uppercase, rng.randint(3, 8)) + "-" + pick(string.digits, rng.randint(8, 12)),
        lambda: "+".join(word() for _ in range(rng.randint(3, 6))),
        *[lambda: rng.choice([str.lower, str.title])(pick(string.ascii_lowercase, rng.randint(1, 15))) + rng.choice(["", "", "."])] * 4,
        lambda: pick(string.ascii_uppercase, rng.randint(1, 6)) + rng.choice(["", "", "."]),
        *[lambda: pick(string.digits, rng.randint(1, 15)) + rng.choice(["", "."])] * 2,
        lambda: word() + pick(string.digits, rng.randint(1, 6)),
        lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2040)}",
        *[lambda: short() + number()] * 3,
        lambda: short() + number() + rng.choice("-./") + rng.choice([number, lambda: short() + number()])(),
        lambda: "".join(short(1) + pick(string.digits, 1) for _ in range(rng.randint(2, 3))),
    )
    out = {k: [f() for _ in range(n)] for k, f in formats.items()}
    out[""] = [f() for f in clean for _ in range(n // 2)]
    return out


def plain_runs(n: int = 120, seed: int = 5) -> list[str]:
    """More strings that are no credentials, without digits: one letter or sign again and again, and long runs of words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    kinds = (
        lambda: rng.choice(string.ascii_letters) * rng.randint(16, 200),
        lambda: rng.choice("=-_./+") * rng.randint(16, 200),
        *(lambda sign=x: sign.join(word() for _ in range(rng.randint(8, 40))) for x in "/-_.+"),
    )
    return [f() for f in kinds for _ in range(n)]


def clean_families(n: int = 160, seed: int = 5) -> dict[str, list[str]]:
    """Strings that are no credentials though they look made by chance, by family; each family has an automaton of its own."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    low, up, dig, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    word = lambda a=2, b=9: pick(low, rng.randint(a, b))
    case = lambda x: rng.choice([x, x.title(), x.upper()])
    number = lambda a=1, b=4: pick(dig, rng.randint(a, b))
    version = lambda: ".".join(number(1, 2) for _ in range(rng.randint(2, 4)))
    stamp = lambda: f"{rng.randint(1990, 2035)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
    uuid = lambda a: "-".join(pick(a, k) for k in (8, 4, 4, 4, 12))
    families = {
        # serial, product and tracking numbers, plates, video ids: short, of any letters and digits
        "code": (
            lambda: pick(up + dig, rng.randint(6, 14)),
            lambda: "-".join(pick(up + dig, rng.randint(2, 6)) for _ in range(rng.randint(2, 4))),
            lambda: pick(up, rng.randint(2, 4)) + "-" + pick(up, 2) + pick(dig, 2) + pick(up, 2) + pick(dig, 2) + pick(up, 2),
            lambda: "1Z" + pick(up + dig, 16),
            lambda: pick(up.replace("I", "").replace("O", "").replace("Q", "") + dig, 17),
            lambda: pick(low + up + dig + "_-", 11),
            lambda: pick(low + dig, rng.randint(5, 12)),
            lambda: pick(hexa, rng.choice([7, 8, 10, 12, 16])),
        ),
        "uuid": (lambda: uuid(hexa), lambda: uuid("0123456789ABCDEF"), lambda: "urn-uuid-" + uuid(hexa), lambda: word() + "-" + uuid(hexa), lambda: word() + "/" + uuid(hexa)),
        "address": (lambda: "0x" + pick(hexa, rng.choice([1, 2, 4, 8, 12, 16])), lambda: "0x" + pick("0123456789ABCDEF", rng.choice([2, 4, 8, 16]))),
        # models, identifiers, packages, files and hosts: words with digits and other words between
        "name": (
            lambda: rng.choice([low, up])[rng.randrange(26)] + word(3, 8).title() + number(1, 4) + word(2, 6).title() + rng.choice(["", word(2, 6).title()]),
            lambda: "".join(word(2, 8).title() + rng.choice(["", number(1, 3)]) for _ in range(rng.randint(2, 6))),
            lambda: word() + "".join(word(2, 8).title() + rng.choice(["", "", number(1, 2), up[rng.randrange(26)]]) for _ in range(rng.randint(1, 6))),
            lambda: "_".join(case(word() + rng.choice(["", "", number(1, 3)])) for _ in range(rng.randint(2, 7))),
            lambda: "-".join(case(word() + rng.choice(["", "", number(1, 3)])) for _ in range(rng.randint(2, 7))),
            lambda: f"{word()}-{version()}-{word(2, 4)}{number(2, 3)}-{word(2, 4)}{number(2, 3)}-{word()}_{number(1, 2)}_{number(1, 2)}_{word()}_{number(2, 2)}." + word(2, 4),
            lambda: f"{word()}-{version()}" + rng.choice(["", "." + word(2, 4), f"-{number(1, 3)}-g{pick(hexa, 7)}", f"-{word()}.{number(1, 2)}"]),
            lambda: f"{case(word(2, 4))}_{stamp()}_{number(4, 6)}" + rng.choice(["", "." + word(3, 4)]),
            lambda: f"{stamp()}-{number(4, 6)}-{word()}" + rng.choice(["", "." + word(3, 4)]),
            lambda: f"{word()}{number(1, 2)}-{number(1, 3)}-{number(1, 3)}-{number(1, 3)}.{word()}-{number(1, 1)}.{word()}.{word(2, 3)}",
            lambda: f"10.{number(4, 5)}/{word(2, 8)}.{number(4, 4)}.{number(2, 6)}",
            lambda: "/".join(rng.choice([word(), word().title(), number(1, 6), word() + number(1, 3), stamp()]) for _ in range(rng.randint(3, 8))),
            lambda: ".".join(rng.choice([word(), word().title(), word() + number(1, 2)]) for _ in range(rng.randint(3, 7))),
            lambda: word(2, 5) + "=" + rng.choice([word(), number(1, 9), word() + number(1, 3)]),
        ),
    }
    return {k: [f() for f in v for _ in range(n)] for k, v in families.items()}


def common_heads(examples: Iterable[Sequence[str]], share: float = 0.03) -> dict[str, str]:
    """The first HEAD characters that at least this share of a format's examples has, each with a symbol of its own."""
    found = set()
    for e in examples:
        found |= {h for h, n in Counter(x[:HEAD] for x in e).items() if n >= share * len(e)}
    return {h: chr(0xE000 + i) for i, h in enumerate(sorted(found))}


def symbols_of(candidate: str, heads: Mapping[str, str]) -> str:
    """One symbol for a common head, then one for each character by its class."""
    head = heads.get(candidate[:HEAD])
    return head + candidate[HEAD:].translate(_CLASSES) if head else candidate.translate(_CLASSES)


@dataclass
class Grammar:
    formats: dict[str, automata.Automaton]
    clean: tuple[automata.Automaton, ...]
    heads: dict[str, str] = field(default_factory=dict)

    def classify(self, candidate: str) -> tuple[str, float]:
        """The likeliest format of the whole candidate and its log likelihood ratio to no credential."""
        symbols = symbols_of(candidate, self.heads)
        best = max(((a.loglik(symbols), k) for k, a in self.formats.items()))
        return best[1], best[0] - max(a.loglik(symbols) for a in self.clean)

    def passes(self, candidate: str) -> str | None:
        """The format of a candidate likely enough to be a credential."""
        kind, score = self.classify(candidate)
        return kind if score >= LEAST and score >= LEAST_EACH * len(candidate) else None

    def within(self, run: str) -> list[tuple[str, int, int]]:
        """A run that passes as a whole, else its parts that do."""
        kind = self.passes(run)
        if kind:
            return [(kind, 0, len(run))]
        parts = [m.span() for m in _PART.finditer(run)]
        if parts in ([], [(0, len(run))]):
            return []
        return [(kind, a, b) for a, b in parts if (kind := self.passes(run[a:b]))]

    def spans(self, text: str, taken: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates that pass, without those that lie within a base span. taken: by start."""
        cleared, found = _cleared(self), {}
        for run in set(_CANDIDATE.findall(text)) - cleared:
            if spans := self.within(run):
                found[run] = spans
            elif len(run) <= SHORT:
                cleared.add(run)
        if len(cleared) > REMEMBERED:
            cleared.clear()
        if not found:
            return []
        starts, ends = [a for _, a, _ in taken], list(accumulate((b for _, _, b in taken), max))
        out = []
        for m in _CANDIDATE.finditer(text):
            for kind, a, b in found.get(m.group(), ()):
                a, b = a + m.start(), b + m.start()
                i = bisect_right(starts, a)
                if not i or ends[i - 1] < b:
                    out.append((kind, a, b))
        return out

    def __hash__(self) -> int:
        return id(self)

    def __eq__(self, other: object) -> bool:
        return self is other


@lru_cache(4)
def _cleared(g: Grammar) -> set[str]:
    """Runs of which a worker knows that nothing in them passes."""
    return set()


def learn(examples: Mapping[str, Sequence[str]] | None = None, alpha: float = 0.01) -> Grammar:
    """examples: by format; those of "" are no credentials. With none given, labelled_examples(), plain_runs() and clean_families().

    What is no credential has an automaton of all its examples, one of those without digits, and one
    for each family; the likeliest counts. Formats are strict: ends and lengths that no example has
    cost as much as whole evidence. Families of codes end at their longest example.
    """
    told = dict(examples or labelled_examples())
    heads = common_heads(v for k, v in told.items() if k)
    by = {k: [symbols_of(x, heads) for x in v] for k, v in told.items()}
    clean = by.pop("")
    plain = [x for x in clean if "d" not in x] + ([] if examples else [symbols_of(x, heads) for x in plain_runs()])
    others = [automata.infer(v, alpha) for v in ((clean, plain) if plain else (clean,))]
    if not examples:
        others += [automata.infer([symbols_of(x, heads) for x in v], alpha, closed=k != "name") for k, v in clean_families().items()]
    return Grammar({k: automata.infer(v, alpha, strict=True) for k, v in sorted(by.items())}, tuple(others), heads)


def all_spans(text: str, grammar: Grammar) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and these with the method's own, by start, then kind."""
    base = base_spans(text)
    more = grammar.spans(text, base)
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[0]))


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """Per row of docs: doc_id, counts of the base kinds, base_sha256, spans.

    Null and empty texts have no spans. Whole texts are scanned, however long, in time linear in
    text and spans. Of formats that are equally likely the last by name is given. Spans of the
    method may touch base spans, but none lies within one. Repeated rows give equal results; null
    doc_id stays null. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(grammar or learn())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("secrets", _cleared.cache_clear)
        for b in slices(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                base, every = all_spans(t or "", sent.value)
                n = [sum(k == x for k, _, _ in base) for x in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(text: str, grammar: Grammar) -> str:
    """The text with each secret replaced by its kind; of spans that overlap, the union."""
    out, at = [], 0
    for kind, a, b in all_spans(text, grammar)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """docs with every secret of text replaced by its kind in brackets; all rows and columns stay, null texts too."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar or learn())
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("secrets", _cleared.cache_clear)
        for b in slices(batches, at):
            new = [t if t is None else redacted(t, sent.value) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=names)

    out = numbered(docs).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
