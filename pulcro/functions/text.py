"""Text expressions. All of them keep null as null and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode_tables as U

# Texts that a table reader takes for a missing value. Fixed values.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Characters a stored name may not hold. Fixed value.
UNSAFE = r"[^a-zA-Z0-9_\-]"

def strip(c: Column) -> Column:
    """Without white space at both ends (Unicode white space, not only U+0020)."""
    return F.trim(c, F.lit(U.spaces()))


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def _jamo(ch: Column) -> Column:
    """A Hangul syllable as jamo, by the arithmetic of the Unicode standard."""
    vowels, tails = len(U.HANGUL_VOWELS), len(U.HANGUL_TAILS) + 1
    index = F.ascii(ch) - U.HANGUL_FIRST
    tail = index % tails
    lead = F.floor(index / (vowels * tails)).cast("int")
    vowel = F.floor((index % (vowels * tails)) / tails).cast("int")
    return F.when(
        F.ascii(ch).between(U.HANGUL_FIRST, U.HANGUL_LAST),
        F.concat(
            F.substring(F.lit(U.HANGUL_LEADS), lead + 1, F.lit(1)),
            F.substring(F.lit(U.HANGUL_VOWELS), vowel + 1, F.lit(1)),
            F.when(tail > 0, F.substring(F.lit(U.HANGUL_TAILS), tail, F.lit(1))).otherwise(""),
        ),
    ).otherwise(ch)


def _expand(c: Column) -> Column:
    """Characters that fold to several ones: ligatures, fractions, Hangul syllables and the like.

    Only texts that may hold such a character are taken apart, into stretches of characters that surely
    fold to at most one and single other ones. Few of the others are found in the table, which Spark
    reads entry by entry, so a translation tells first which are.
    """
    many, sure = U.foldings()[2], U.never_expanded()
    entries = [F.split(F.lit("\x02".join(part)), "\x02") for part in (many, many.values())]
    table = F.map_from_arrays(*entries)
    stretches = F.regexp_extract_all(c, F.lit(f"[{sure}]+|[^{sure}]"), F.lit(0))
    expanded = F.transform(
        stretches,
        lambda part: F.when(F.length(part) > 1, part)
        .when(F.translate(part, "".join(many), "") == "", F.try_element_at(table, part))
        .otherwise(_jamo(part)),
    )
    return F.when(c.rlike(f"[^{sure}]"), F.array_join(expanded, "")).otherwise(c)


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks (``José`` -> ``Jose``, ``ﬁ`` -> ``fi``)."""
    return F.translate(_expand(c), *U.fold_translation())


def fold_text(c: Column) -> Column:
    """Lower case without accents, the form that look-ups compare."""
    return fold_accents(F.lower(c))


def clean_text(c: Column) -> Column:
    """Without accents and ASCII punctuation, white space collapsed; blank text becomes ``''``."""
    bare = F.translate(_expand(c), *U.clean_translation())
    return F.trim(F.regexp_replace(bare, "  +", " "))


def replace_exact(c: Column, find: str, new: str) -> Column:
    """Cells that equal ``find`` become ``new``."""
    return F.when(c == F.lit(find), F.lit(new)).otherwise(c)


def replace_part(c: Column, find: str, new: str) -> Column:
    """Every occurrence of ``find`` becomes ``new``; both are literal texts."""
    return F.replace(c, F.lit(find), F.lit(new))


def first_word(c: Column) -> Column:
    """First word of a full name; null when blank."""
    return F.nullif(F.regexp_extract(strip(c), f"^({U.NOT_SPACE}+)", 1), F.lit(""))


def other_words(c: Column) -> Column:
    """What follows the first word, inner spacing kept; null when there is none."""
    rest = F.regexp_extract(strip(c), f"(?s)^{U.NOT_SPACE}+{U.SPACE}+(.*)\\z", 1)
    return F.nullif(rest, F.lit(""))


def safe_name(c: Column) -> Column:
    """Name under which a rule set is stored."""
    return F.regexp_replace(strip(c), UNSAFE, "_")
