"""Operator 2, secret scan: assignments, access keys, hexadecimal runs and high-entropy strings.

Everything is a Spark expression over one text, so the scan needs no shuffle. Entropy is the Shannon
entropy of a window that slides over a candidate string. Counts per symbol of the candidate's
character class are kept while it slides: one goes up, one goes down, and the sum of c log c changes
by those two terms only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulcro.llm.common import running_sums, text_or_empty

#: Fixed patterns of the scan; the last group of an assignment is its value.
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
    "([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Strings that the entropy scan looks at.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"


class CharClass(NamedTuple):
    """A character class: which strings it takes, its symbols, window and least entropy in bits."""

    name: str
    pattern: str
    alphabet: str
    window: int
    bits: float


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: The first class whose pattern takes the whole candidate holds.
CLASSES = (
    CharClass("hex", "[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdefABCDEF", 20, 3.0),
    CharClass("alnum", "[A-Za-z0-9]+", DIGITS + LOWER + LOWER.upper(), 20, 3.6),
    CharClass("base64", "[A-Za-z0-9+/_=-]+", DIGITS + LOWER + LOWER.upper() + "+/_=-", 20, 3.7),
)
#: Candidates that are no secrets: words and paths without a digit, plain numbers, UUIDs and dates
#: joined by signs, placeholders, one symbol or pair repeated.
ALLOWED = (
    "[^0-9]+",
    "[0-9+/_=-]+",
    "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "(?i).*(example|changeme|placeholder|dummy|xxxx|your_?).*",
    "(.{1,2})\\1+.?",
)


def _spans(text: str, pattern: str) -> Column:
    """array<struct<a, b, hit>> of the leftmost non-overlapping matches: characters before, length, text.

    Matches and what lies between them are both taken once from the whole text and laid side by side.
    """
    regex = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = (
        f"zip_with(regexp_extract_all({text}, {regex}, 0), split({text}, {regex}, -1), (h, gap) -> if(h is null, null, "
        "struct(cast(length(gap) as bigint) as a, cast(length(h) as bigint) as b, h as hit)))"
    )
    return F.expr(f"filter({pairs}, s -> s is not null)")


def _placed(steps: str) -> Column:
    """Turns (characters before, length, hit) into (start, end, hit)."""
    ends = running_sums(f"transform({steps}, s -> s.a + s.b)")
    return F.expr(
        f"if(size({steps}) = 0, cast(array() as array<struct<start:bigint,end:bigint,hit:string>>), "
        f"zip_with({steps}, {ends}, "
        "(s, e) -> struct(e - s.b as start, e as end, s.hit as hit)))"
    )


def _running_greatest(array: str) -> str:
    """SQL for the greatest of all elements up to and including each one, in chunks of 512."""
    chunks = (
        f"transform(sequence(0, greatest(cast(ceil(size({array}) / 512.0) as int) - 1, 0)), "
        f"k -> slice({array}, k * 512 + 1, 512))"
    )
    bases = (
        f"aggregate({chunks}, array(-1L), (acc, c) -> concat(acc, array("
        "greatest(element_at(acc, -1), array_max(c)))))"
    )
    return (
        f"flatten(zip_with({chunks}, slice({bases}, 1, size({chunks})), (c, b) -> slice("
        "aggregate(c, array(b), (acc, x) -> concat(acc, array(greatest(element_at(acc, -1), x)))), 2, size(c))))"
    )


def window_entropy(hit: str, kind: CharClass) -> str:
    """SQL: the greatest entropy, in bits, of any window of ``kind.window`` symbols of ``hit``."""
    w, n = kind.window, len(kind.alphabet)
    at = f"locate(x, '{kind.alphabet}')"
    # State: counts per symbol, sum of c log2 c, greatest entropy. (c + 1) log (c + 1) - c log c goes
    # in for the entering symbol, its reverse for the leaving one.
    bump = "((c + 1) * log2(c + 1) - if(c = 0, 0D, c * log2(c)))"
    enter = f"aggregate(array(acc.n[{at} - 1]), 0D, (s, c) -> s + {bump})"
    grown = (
        f"struct(transform(acc.n, (c, k) -> if(k = {at} - 1, c + 1, c)) as n, "
        f"acc.s + {enter} as s, acc.best as best, acc.i as i)"
    )
    out = f"locate(chars[acc.i - {w}], '{kind.alphabet}')"
    fall = "(if(c = 1, 0D, (c - 1) * log2(c - 1)) - c * log2(c))"
    left = (
        f"if(acc.i < {w}, acc, struct(transform(acc.n, (c, k) -> if(k = {out} - 1, c - 1, c)) as n, "
        f"acc.s + aggregate(array(acc.n[{out} - 1]), 0D, (s, c) -> s + {fall}) as s, "
        "acc.best as best, acc.i as i))"
    )
    step = (
        f"aggregate(array({left}), acc, (old, acc) -> aggregate(array({grown}), acc, (o, a) -> "
        f"struct(a.n as n, a.s as s, if(a.i + 1 >= {w}, greatest(a.best, log2({w}) - a.s / {w}), "
        "a.best) as best, a.i + 1 as i)))"
    )
    start = f"struct(array_repeat(0, {n}) as n, 0D as s, 0D as best, 0 as i)"
    return (
        f"aggregate(array(split({hit}, '')), 0D, (b, chars) -> "
        f"aggregate(chars, {start}, (acc, x) -> {step}, acc -> acc.best))"
    )


def _is_secret(hit: str) -> str:
    allowed = " OR ".join(f"{hit} rlike '^({p})$'".replace("\\", "\\\\") for p in ALLOWED)
    entropy = "".join(
        f"WHEN {hit} rlike '^({k.pattern})$' THEN {window_entropy(hit, k)} >= {k.bits}D " for k in CLASSES
    )
    return f"CASE WHEN {allowed} THEN false {entropy} ELSE false END"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``secrets``: array<struct<kind, start, end, hit>> by start, then kind as listed.

    Kinds: assign, access, hex (the base scan) and entropy, for candidates that overlap no span of
    the base scan. Offsets count code points, the end is exclusive. A null or empty text has none.
    One row per input row, repeated rows included; other columns are not read. Time is linear in the
    text and its spans, but for sorting them.
    """
    found = docs.select("doc_id", text_or_empty().alias("text"))
    kinds = (("assign", ASSIGN), ("access", ACCESS), ("hex", f"{HEX[:-1]}{{{MIN_HEX},}}"), ("entropy", CANDIDATE))
    found = found.select("doc_id", *[_spans("text", p).alias(f"s_{k}") for k, p in kinds])
    found = found.select("doc_id", *[_placed(f"s_{k}").alias(k) for k, _ in kinds])
    value = "'" + ASSIGN.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = found.withColumn(
        "assign", F.expr(f"filter(assign, s -> length(regexp_extract(s.hit, {value}, 2)) >= {MIN_VALUE})")
    ).withColumn("access", F.expr(f"filter(access, s -> length(s.hit) >= {MIN_ACCESS})"))
    found = found.withColumn("entropy", F.expr(f"filter(entropy, s -> {_is_secret('s.hit')})"))
    # A span overlaps none of the base if none that begins before its end ends behind its start: base
    # spans by start and candidates by end are put in one order, with the greatest end so far.
    bases = "transform(concat(assign, access, hex), s -> struct(s.start as at, 1 as base, s.end as end, s as span))"
    found = found.withColumn(
        "events",
        F.expr(f"array_sort(concat({bases}, transform(entropy, s -> struct(s.end as at, 0 as base, -1L as end, s as span))))"),
    )
    found = found.withColumn("ends", F.expr(_running_greatest("transform(events, e -> e.end)")))
    alone = "zip_with(events, ends, (e, most) -> if(e.base = 0 and most <= e.span.start, e.span, null))"
    found = found.withColumn("entropy", F.expr(f"filter({alone}, s -> s is not null)"))
    ranked = ", ".join(
        f"transform({k}, s -> struct(s.start as start, {i} as rank, '{k}' as kind, s.end as end, s.hit as hit))"
        for i, (k, _) in enumerate(kinds)
    )
    return found.select(
        "doc_id",
        F.expr(
            f"transform(array_sort(concat({ranked})), "
            "s -> struct(s.kind as kind, s.start as start, s.end as end, s.hit as hit))"
        ).alias("secrets"),
    )
