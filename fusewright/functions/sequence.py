"""Column functions over sequences, identifiers and attribute strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases and brackets with their complements.
BASES, COMPLEMENTS = "atcgATCG[]", "tagcTAGC]["
#: The standard genetic code, codons in TCAG order.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
ORDER = "TCAG"
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(ORDER) for j, b in enumerate(ORDER) for k, c in enumerate(ORDER)}


def complement(s: Column) -> Column:
    """Complements bases in their case, swaps brackets, keeps the rest."""
    return F.translate(s, BASES, COMPLEMENTS)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def kmer_code(s: Column) -> Column:
    """A k-mer as a number of base 4: T 0, G 1, C 2, anything else 3."""
    digits = F.regexp_replace(F.translate(s, "TGC", "012"), "[^012]", "3")
    return F.conv(digits, 4, 10).cast("bigint")


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k, overlapping ones too, in time linear in the sequence; none if it is shorter."""
    return F.coalesce(F.regexp_extract_all(s, F.lit(f"(?=(.{{{k}}}))"), F.lit(1)), F.array().cast("array<string>"))


def translate_codons(s: Column) -> Column:
    """The protein of whole codons; unknown codons are ?."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    codons = F.regexp_extract_all(F.upper(s), F.lit("(...)"))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(table[c], F.lit("?"))), "")


def has_homopolymer(s: Column, length: int) -> Column:
    """Whether one character repeats length times on end."""
    return s.rlike(rf"(.)\1{{{length - 1}}}")


def strip_chr(s: Column) -> Column:
    """Contig names without the prefix chr; M is MT."""
    bare = F.regexp_replace(s, "^chr", "")
    return F.when(bare == "M", F.lit("MT")).otherwise(bare)


def strip_version(s: Column) -> Column:
    """Identifiers of the ENS family without their version."""
    return F.when(s.startswith("ENS"), F.regexp_replace(s, r"\..*$", "")).otherwise(s)


def read_group(read_key: Column) -> Column:
    """A read key without what follows its last comma."""
    return F.regexp_replace(read_key, ",[^,]*$", "")


def wildcard_regex(patterns: str) -> str:
    """Blank- or comma-separated contig patterns with * as one anchored regular expression."""
    import re

    parts = [re.escape(p).replace(r"\*", ".*") for p in re.split(r"[\s,]+", patterns.strip()) if p]
    return f"^(?:{'|'.join(parts)})$" if parts else "^(?!)$"


def gtf_attribute(attributes: Column, names: str) -> Column:
    """The quoted value of the first of the |-separated names that occurs; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(attributes, rf'(?:^|[; ]){n} "([^"]*)"', 1), F.lit("")) for n in names.split("|")])


def gff3_attribute(attributes: Column, name: str) -> Column:
    """The value after the first name=, up to a semicolon; null if there is none."""
    return F.nullif(F.regexp_extract(attributes, rf"{name}=([^;]*)", 1), F.lit(""))


def percent_decoded(s: Column) -> Column:
    """Decodes %xx; a text with an invalid escape stays as it is; + isn't a blank."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def domain_name(s: Column) -> Column:
    """A decoded name whose unprintable characters, commas and bars are underscores."""
    return F.regexp_replace(percent_decoded(s), "[^!-~]|[,|]", "_")


def tag_name(s: Column) -> Column:
    return F.regexp_replace(s, "[^!-~]|,", "_")
