"""Text that must fit a byte limit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
TITLE_BYTES = 256
CATEGORY_BYTES = 128
MAX_CATEGORIES = 32

# The characters that count as white space at the edges of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def bounded_text(text: Column | str, max_bytes: int, strip_controls: bool = False) -> Column:
    """Trimmed text cut to ``max_bytes`` bytes between characters; null when nothing is left."""
    text = F.col(text) if isinstance(text, str) else text
    if strip_controls:
        text = F.regexp_replace(text, r"\p{Cc}", "")
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    raw = F.encode(trimmed, "UTF-8")
    # A cut inside a character leaves at most three of its bytes: the first valid prefix wins.
    cuts = [F.substring(raw, 1, max_bytes - back) for back in range(4)]
    cut = F.coalesce(*[F.when(F.is_valid_utf8(c), c.cast("string")) for c in cuts])
    return (
        F.when(trimmed == "", None)
        .when(F.octet_length(trimmed) <= max_bytes, trimmed)
        .otherwise(cut)
    )


def bounded_categories(categories: Column | str) -> Column:
    """At most 32 non-empty categories, each cut to 128 bytes."""
    kept = F.filter(
        F.transform(categories, lambda c: bounded_text(c, CATEGORY_BYTES)), lambda c: c.isNotNull()
    )
    return F.slice(kept, 1, MAX_CATEGORIES)
