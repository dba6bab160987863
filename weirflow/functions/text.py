"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All of Unicode's white space, which ends with the ideographic space.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Word characters of any language, not only ASCII.
NON_WORD = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NON_WORD), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Words plus the singular of simple plurals, so that "certificates" also finds "certificate"."""
    base = words(text)
    plural = F.filter(base, lambda w: (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"))
    return F.concat(base, F.transform(plural, lambda w: F.substring(w, F.lit(1), F.length(w) - 1)))


def strip(text: Column) -> Column:
    """Without white space at the ends; looks at the ends only, unlike a pattern."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def literals(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences."""
    gone = F.length(F.replace(text, term, F.lit("")))
    return ((F.length(text) - gone) / F.length(term)).cast("long")
