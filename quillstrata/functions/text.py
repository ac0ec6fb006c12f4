"""Column expressions on texts and keys; all of them stay in generated JVM code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and the letters they stand on, from the Unicode decompositions."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks; combining marks after a letter vanish too."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"\p{M}+", "")


def uuid_key(value: Column) -> Column:
    """The key a uuid text denotes, however it is written; null where it denotes none.

    Letter case, enclosing signs, a urn prefix, hyphens and surrounding blanks
    do not matter. An empty or blank text is no key.
    """
    plain = F.regexp_replace(F.lower(value), r"urn:|uuid:", "")
    return F.nullif(F.regexp_replace(plain, r"[^0-9a-z]", ""), F.lit(""))


def or_empty(value: Column) -> Column:
    """Absent is the empty string in most places and null in some: make it one."""
    return F.coalesce(value, F.lit(""))
