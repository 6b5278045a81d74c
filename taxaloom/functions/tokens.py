"""Expressions over the text fields of classified reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_kmers(kmers: Column) -> Column:
    """White-space tokens that hold a colon; NULL gives none."""
    return F.coalesce(F.filter(F.split(F.trim(kmers), r"\s+"), lambda x: F.contains(x, F.lit(":"))), F.array().cast("array<string>"))


def numeric_tokens(kmers: Column) -> Column:
    """``taxid:count`` pairs in order, as structs; ambiguous tokens match nothing and so take no position."""
    found = F.regexp_extract_all(F.coalesce(kmers, F.lit("")), F.lit(r"(\d+):(\d+)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.split(x, ":")[0].try_cast("bigint").alias("taxid"), F.split(x, ":")[1].try_cast("bigint").alias("cnt")))


def taxid_of(text: Column) -> Column:
    """Taxid of ``Name (taxid N)``, ``(N)`` or ``N``; NULL where there is no number."""
    last = F.element_at(F.split(F.trim(text), r"\s+"), -1)
    return F.btrim(last, F.lit("()")).try_cast("bigint")


def reported_taxid(text: Column) -> Column:
    """Taxid of a classifier's taxonomy field: the last token without its closing bracket."""
    return F.rtrim(F.element_at(F.split(F.trim(text), r"\s+"), -1), F.lit(")")).try_cast("bigint")


def true_taxon_text(read_id: Column, taxonomy: Column) -> Column:
    """The second ``|`` field of the read id, else the reported taxonomy."""
    return F.coalesce(F.try_element_at(F.split(read_id, r"\|"), F.lit(2)), taxonomy)


def accession(name: Column) -> Column:
    """Accession of a simulated read's name: before the slash, without its last character, version cut to one digit.

    The pattern is a fixed value.
    """
    stem = F.substring_index(name, "/", 1)
    return F.regexp_replace(F.left(stem, F.greatest(F.length(stem) - 1, F.lit(0))), r"\.(\d)\d*(?:_.*)?", r".$1")


def genome_key(fasta: Column) -> Column:
    """Last ``__`` field of a genome file name."""
    return F.element_at(F.split(fasta, "__"), -1)


def genome_taxid(fasta: Column) -> Column:
    """Third ``__`` field of a genome file name, as a number."""
    return F.try_element_at(F.split(fasta, "__"), F.lit(3)).try_cast("bigint")


def finite(x: Column) -> Column:
    """The value, or NULL where it is not a finite number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
