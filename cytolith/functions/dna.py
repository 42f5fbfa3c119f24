"""Column functions on DNA strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGTN"


def hamming(a: Column, b: Column) -> Column:
    """Mismatches over the common length (the longer string is cut, as a positional zip does)."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda z: z))


def neighbours(barcode: Column, distance: int = 1, alphabet: str = ALPHABET) -> Column:
    """Array of all strings within so many substitutions, the string itself included."""
    letters = F.array(*map(F.lit, alphabet))
    found = F.array(barcode)
    for _ in range(distance):
        once = lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.transform(letters, lambda x: F.concat(F.substring(s, F.lit(1), i - 1), x, F.substring(s, i + 1, F.length(s))))))
        found = F.array_distinct(F.flatten(F.transform(found, once)))
    return found


def count_base(barcode: Column, base: str) -> Column:
    """How often a base occurs."""
    return F.length(barcode) - F.length(F.replace(barcode, F.lit(base)))


def is_homopolymer(sequence: Column) -> Column:
    """Whether all bases are the same."""
    return sequence == F.repeat(F.substring(sequence, 1, 1), F.length(sequence))


def within_poly_t(sequence: Column, mismatches: int = 1) -> Column:
    """Whether at most so many bases aren't T."""
    return F.length(F.translate(sequence, "T", "")) <= mismatches


def passes_n_rule(barcode: Column) -> Column:
    """At most one N in each component (split by -), and at most as many in all as there are components."""
    counts = F.transform(F.split(barcode, "-"), lambda x: count_base(x, "N"))
    return ~F.exists(counts, lambda n: n > 1) & (F.aggregate(counts, F.lit(0), lambda a, b: a + b) <= F.size(counts))


def gene_short_name(gene: Column) -> Column:
    """The text after the first underscore of id_name."""
    return F.regexp_replace(gene, "^[^_]*_", "")


#: Patterns of mitochondrial and ribosomal gene names by species (fixed values).
MITO = {"human": "MT-", "mouse": "mt-"}
MITO_RIBO = {"human": "^MT-|^RPL|^RPS|^MRPS|^MRPL", "mouse": "^mt-|^Rpl|^Rps|^Mrps|^Mrpl"}
IGNORED = {"human": "MALAT1|^MTRNR", "mouse": "Malat1|^Mtrnr"}
