"""Allele codes and scalar functions on them, as Column expressions.

A call is two nullable codes; null is unknown. Predicates on unknown calls are false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the codes 0..6 (insertion +, gap -, undefined Z).
LETTERS = ("A", "C", "G", "T", "+", "-", "Z")
# One-letter names of unordered pairs of different nucleotides.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTMRWSYKacgtmrwsyk", "TGCAKYWSRMtgcakywsrm"


def letter(code: Column) -> Column:
    """Letter of an allele code; N for unknown."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in LETTERS]), code.cast("int")), F.lit("N"))


def code_of(letter_: Column) -> Column:
    """Allele code of a letter; null for N and anything else."""
    table = F.create_map(*[x for i, l in enumerate(LETTERS) for x in (F.lit(l), F.lit(i))])
    return F.try_element_at(table, F.upper(letter_))


def codes_of_text(text: Column) -> Column:
    """The list of allele codes of a sequence; null for N and anything else."""
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: code_of(x))


def text_of_codes(codes: Column) -> Column:
    """The sequence of a list of allele codes, N for null."""
    return F.array_join(F.transform(codes, lambda x: letter(x)), "")


def diploid(a1: Column, a2: Column) -> Column:
    """Two letters of a call, as stored."""
    return F.concat(letter(a1), letter(a2))


def iupac(a1: Column, a2: Column) -> Column:
    """One letter of a call: IUPAC for nucleotide heterozygotes, 0 for a heterozygous indel, the known base where one is unknown."""
    low, high = F.least(a1, a2), F.greatest(a1, a2)
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    pair = F.concat(letter(low), letter(high))
    return (
        F.when(a1.isNull() & a2.isNull(), "N")
        .when(a1.isNull() | a2.isNull(), letter(F.coalesce(a1, a2)))
        .when(a1 == a2, letter(a1))
        .when(F.least(low, F.lit(3)) == high, letter(high))
        .otherwise(F.coalesce(F.try_element_at(table, pair), F.when((low == 4) & (high == 5), "0").when(high >= 4, "0"), F.lit("N")))
    )


def call_of(text: Column) -> tuple[Column, Column]:
    """Codes of a one-letter (IUPAC) or two-letter call."""
    back = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (v, k)])
    two = F.when(F.length(text) == 2, F.upper(text)).otherwise(
        F.coalesce(F.try_element_at(back, F.upper(text)), F.when(text == "0", "+-"), F.concat(F.upper(text), F.upper(text)))
    )
    return code_of(F.substring(two, 1, 1)), code_of(F.substring(two, 2, 1))


def pack(a1: Column, a2: Column, phased: bool = False) -> Column:
    """One byte of a call, unknown as 15; unphased packing puts the lower code first."""
    x, y = F.coalesce(a1, F.lit(15)), F.coalesce(a2, F.lit(15))
    if not phased:
        x, y = F.least(x, y), F.greatest(x, y)
    return F.shiftleft(x.cast("int"), 4).bitwiseOR(y.cast("int"))


def unpack(byte: Column) -> tuple[Column, Column]:
    first, second = F.shiftright(byte, 4).bitwiseAND(F.lit(15)), byte.bitwiseAND(F.lit(15))
    return F.when(first != 15, first), F.when(second != 15, second)


def complement(sequence: Column) -> Column:
    """Complement of a sequence of nucleotide or IUPAC letters; other letters stay."""
    return F.translate(sequence, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def is_heterozygous(a1: Column, a2: Column) -> Column:
    return F.coalesce(a1 != a2, F.lit(False))


def is_homozygous(a1: Column, a2: Column) -> Column:
    return F.coalesce(a1 == a2, F.lit(False))


def is_acgt(a1: Column, a2: Column) -> Column:
    return F.coalesce((a1 < 4) & (a2 < 4), F.lit(False))
