"""Tests of a token by word lists and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amino acids (name, three letters), by polarity and charge.
AMINO_ACIDS = [
    ("glycine", "gly"), ("alanine", "ala"), ("valine", "val"), ("leucine", "leu"), ("isoleucine", "ile"), ("methionine", "met"), ("phenylalanine", "phe"), ("tryptophan", "trp"), ("proline", "pro"),
    ("serine", "ser"), ("threonine", "thr"), ("cysteine", "cys"), ("tyrosine", "tyr"), ("asparagine", "asn"), ("glutamine", "gln"),
    ("aspartic acid", "asp"), ("glutamic acid", "glu"), ("lysine", "lys"), ("arginine", "arg"), ("histidine", "his"),
]


def amino_acid(token: Column) -> Column:
    """The name of the first listed amino acid whose name a token contains, or whose three letters it has as a word; null without one."""
    low = F.lower(token)
    tests = [F.when(F.contains(low, F.lit(name)) | low.rlike(rf"(?<!\p{{L}}){code}(?!\p{{L}})"), F.lit(name)) for name, code in AMINO_ACIDS]
    return F.coalesce(*tests)


def is_dna(token: Column) -> Column:
    """Whether a token consists of the letters a, c, g and t in lower case only."""
    return token.rlike("^[acgt]+$")


def is_range(before: Column, mark: Column, token: Column) -> Column:
    """Whether two numbers, each with a sign or without, stand around ``to``, ``and`` or a hyphen."""
    number = lambda c: F.regexp_replace(c, "^[-+]", "").rlike(r"^\d+$")
    return F.coalesce(F.lower(mark).isin("to", "and", "-") & number(before) & number(token), F.lit(False))


def contains_word(token: Column, words: list[str]) -> Column:
    """The first listed word that a token contains in lower case; null without one."""
    return F.coalesce(*[F.when(F.contains(F.lower(token), F.lit(w)), F.lit(w)) for w in words])
