"""Fill-in-middle transformation: bit-parallel token boundaries on big integers.

A text is one bit a code point. bytes.translate turns it into the mask of its letters; shifted
boolean operations leave a bit where a token starts; bit_count gives the number of tokens, and
halving the integer again and again finds the place of a ranked bit. All of it is linear.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tenant

#: The markers, and shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 90, 20
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CLASS = bytes(49 if c in LETTERS else 48 for c in range(256))
SCHEMA = "doc_id bigint, n long, form string, prefix_chars long, middle_chars long, output string"


def starts(text: str) -> int:
    """An integer whose bit i is set where a token (a run of letters, or any other code point) starts at code point i."""
    if not text:
        return 0
    mask = text.encode("ascii", "replace").translate(_CLASS)  # one byte a code point; what isn't ASCII is no letter
    letters = int(mask[::-1], 2)
    return ~(letters & (letters << 1)) & ((1 << len(text)) - 1)


def ranked(bits: int, width: int, rank: int) -> int:
    """The place of the set bit that has rank set bits below it; width where there are no more."""
    if rank >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers of a document."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(said[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(doc_id: int | None, text: str, seed: int = 1, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    bits = starts(text)
    n = bits.bit_count()
    a, b, kept, order = draws(seed, doc_id)
    if not text or kept % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((a % (n + 1), b % (n + 1)))
    i = ranked(bits, len(text), first)
    j = ranked(bits, len(text), last)
    form = "spm" if order % 100 < spm else "psm"
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, i, j - i, output


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Per row of docs: doc_id, n, form, prefix_chars, middle_chars, output (the transformed text).

    Null and empty texts: n 0, plain, empty output. A text that holds a marker is plain. Very long
    texts are cut whole, in linear time. Null doc_id: drawn as an empty number. Repeated rows and
    rows of one doc_id draw alike, so equal rows give equal values; there are no ties. Empty table:
    empty result. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("fim")
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in slices(batches, 1, 4 << 20):
            rows = [transform(i, t or "", seed, rate, spm) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with markers stay plain, and no marker overlaps another, so the first of each is the right one."""
    second = F.when(form == "spm", F.locate(PREFIX, output)).otherwise(F.locate(SUFFIX, output))
    third = F.locate(MIDDLE, output)
    one = F.substring(output, F.lit(len(PREFIX) + 1), second - len(PREFIX) - 1)
    two = F.substring(output, second + len(PREFIX), third - second - len(PREFIX))
    middle = F.substring(output, third + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


#: fill_in_middle() with its defaults over the table documents, and its digests, for DuckDB.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
drawn AS (
  SELECT *, len(tokens)::BIGINT AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
         ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
         array_to_string(tokens[b + 1:], '') AS suffix FROM formed)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM pieces
"""
