"""Normal forms of the identifiers, names and scores in the raw tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as surrounding white space.
WHITE = " \t\n\r\x0b\x0c  　﻿"

# Aspect letters and the ontology names they stand for.
ASPECT_NAMES = {
    "f": "F",
    "molecular_function": "F",
    "molecular function": "F",
    "p": "P",
    "biological_process": "P",
    "biological process": "P",
    "c": "C",
    "cellular_component": "C",
    "cellular component": "C",
}

# Words that stand for "no value" in a key column.
NO_VALUE = (
    "null", "none", "n/a", "na", "nan", "nil", "unknown", "undefined", "missing",
    "unspecified", "not available", "not applicable", "no value", "tbd", "empty", "void", "?",
)


def bare(value: Column) -> Column:
    """``value`` without surrounding white space, tabs included."""
    return F.trim(value, F.lit(WHITE))


def protein(accession: Column) -> Column:
    """A protein accession: no surrounding white space, upper case; blank becomes null."""
    name = F.upper(bare(accession))
    return F.when(name != "", name)


def usable(score: Column) -> Column:
    """Whether a score is neither null nor NaN and lies within 0..1."""
    return F.coalesce(~F.isnan(score) & score.between(0.0, 1.0), F.lit(False))


def aspect(name: Column) -> Column:
    """F, P or C for a letter or a full ontology name, else null."""
    table = F.create_map(*[F.lit(x) for pair in ASPECT_NAMES.items() for x in pair])
    return table[F.lower(bare(name))]


def term_number(identifier: Column) -> Column:
    """The number in a term identifier as a long; null without one."""
    return F.regexp_extract(identifier, r"(\d+)", 1).try_cast("bigint")


def term_id(number: Column) -> Column:
    """``GO:`` and at least seven digits."""
    digits = number.cast("string")
    return F.concat(F.lit("GO:"), F.lpad(digits, F.greatest(F.length(digits), F.lit(7)), F.lit("0")))


def source_key(name: Column) -> Column:
    """A source name ignoring case, surrounding white space and blank, hyphen or underscore."""
    return F.regexp_replace(F.lower(bare(name)), r"[\s\-_]", "_")


def accession_core(accession: Column) -> Column:
    """The first letter-and-eight-digits core of an accession in upper case, else null."""
    core = F.upper(F.regexp_extract(accession, r"([A-Za-z]\d{8})", 1))
    return F.when(core != "", core)


def checksum_key(checksum: Column) -> Column:
    """A checksum in lower case, or null where it says nothing (blank, dashes, zeros, no-value words)."""
    value = F.lower(bare(checksum))
    empty = (value == "") | value.rlike(r"^(0+|-+|_+|\.+)$") | value.isin(*NO_VALUE)
    return F.when(~empty, value)
