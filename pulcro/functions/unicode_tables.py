"""Character classes and folding tables, generated from the Unicode database of Python.

Everything here is built by rule when first asked for; regex classes use a spelling that both
Java and RE2 accept.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

#: Characters that count as white space (``str.isspace``).
SPACE_CLASS = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
SPACE = f"[{SPACE_CLASS}]"
NOT_SPACE = f"[^{SPACE_CLASS}]"

# Hangul syllables decompose by arithmetic, three jamo tables and one offset.
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
HANGUL_LEADS = "".join(map(chr, range(0x1100, 0x1113)))
HANGUL_VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
HANGUL_TAILS = "".join(map(chr, range(0x11A8, 0x11C3)))

PUNCTUATION = string.punctuation


def _assigned() -> Iterator[str]:
    """Characters outside ASCII that may decompose or carry a numeric or combining property."""
    for code in range(0x80, 0x30000):
        if not 0xD800 <= code <= 0xF8FF or code in (0xFEFF,):
            yield chr(code)
    for code in range(0xE0000, 0xE01F0):
        yield chr(code)


def _class_body(test: Callable[[str], bool]) -> str:
    """Ranges of the characters that satisfy ``test``, as the body of a regex class."""
    runs: list[list[int]] = []
    for char in _assigned():
        if test(char):
            code = ord(char)
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "".join(
        f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs
    )


@lru_cache(maxsize=None)
def spaces() -> str:
    """All white-space characters, as a string for ``trim``."""
    return "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


@lru_cache(maxsize=None)
def numeric() -> str:
    """Class of ``str.isnumeric``: every number category plus ideographs with a numeric value."""
    extra = _class_body(lambda c: c.isnumeric() and unicodedata.category(c)[0] != "N")
    return rf"[\p{{N}}{extra}]"


@lru_cache(maxsize=None)
def digit() -> str:
    """Class of ``str.isdigit``: decimal digits plus superscripts, circled digits and the like."""
    extra = _class_body(lambda c: c.isdigit() and unicodedata.category(c) != "Nd")
    return rf"[\p{{Nd}}{extra}]"


@lru_cache(maxsize=None)
def decimal_digits() -> tuple[str, str]:
    """Decimal digits of all scripts and the ASCII digits they stand for."""
    chars = [c for c in _assigned() if unicodedata.category(c) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


@lru_cache(maxsize=None)
def foldings() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without their marks.

    Returns the one-to-one pairs as two parallel strings, and the expansions to several
    characters as a dict. Hangul syllables are left out: see the jamo tables above.
    """
    single_from, single_to, many = [], [], {}
    for char in _assigned():
        if HANGUL_FIRST <= ord(char) <= HANGUL_LAST:
            continue
        full = unicodedata.normalize("NFKD", char)
        bare = "".join(c for c in full if not unicodedata.combining(c))
        if bare == char or not bare:
            continue
        if len(bare) == 1:
            single_from.append(char)
            single_to.append(bare)
        else:
            many[char] = bare
    return "".join(single_from), "".join(single_to), many


@lru_cache(maxsize=None)
def never_expanded(ranges: int = 48) -> str:
    """ASCII and the longest ranges of characters that fold to at most one, as the body of a regex class."""
    edges = [0x7F, *sorted(map(ord, foldings()[2])), HANGUL_FIRST, HANGUL_LAST, 0x110000]
    edges = sorted(set(edges))
    gaps = [(b - a, a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a > 2 and (a, b) != (HANGUL_FIRST, HANGUL_LAST)]
    longest = sorted(sorted(gaps, reverse=True)[:ranges], key=lambda gap: gap[1])
    return r"\x{0}-\x{7f}" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for _, a, b in longest)


def _translation(pairs: dict[str, str]) -> tuple[str, str]:
    """Arguments of ``translate``: characters without a counterpart come last and are dropped."""
    kept = {a: b for a, b in pairs.items() if b}
    dropped = [a for a, b in pairs.items() if not b]
    return "".join([*kept, *dropped]), "".join(kept.values())


@lru_cache(maxsize=None)
def fold_translation() -> tuple[str, str]:
    """One-to-one foldings, combining marks dropped."""
    single_from, single_to, _ = foldings()
    marks = {c: "" for c in _assigned() if unicodedata.combining(c)}
    return _translation({**dict(zip(single_from, single_to)), **marks})


@lru_cache(maxsize=None)
def clean_translation() -> tuple[str, str]:
    """Foldings, with punctuation dropped and every white space a blank."""
    single_from, single_to = fold_translation()
    bare = dict(zip(single_from, single_to))
    bare.update(dict.fromkeys(single_from[len(single_to):], ""))
    bare.update({c: c for c in PUNCTUATION + spaces() if c not in bare})
    result = {}
    for char, folded in bare.items():
        if folded in PUNCTUATION:
            folded = ""
        elif folded.isspace():
            folded = " "
        if folded != char:
            result[char] = folded
    return _translation(result)
