"""Country code from free text: the longest known place name that occurs in it wins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.columns import match_key
from ..session import is_small, materialise
from . import text

# Place names (lower case, without accents) and their ISO codes. Fixed values.
PLACES = {
    "alemania": "DE",
    "canada": "CA",
    "china": "CN",
    "chile": "CL",
    "colombia": "CO",
    "corea del sur": "KR",
    "costa rica": "CR",
    "dinamarca": "DK",
    "ecuador": "EC",
    "el salvador": "SV",
    "espana": "ES",
    "estados unidos": "US",
    "usa": "US",
    "u.s.a.": "US",
    "u. s. a.": "US",
    "united states": "US",
    "francia": "FR",
    "guatemala": "GT",
    "honduras": "HN",
    "islas virgenes britanicas": "VG",
    "british virgin islands": "VG",
    "mexico": "MX",
    "noruega": "NO",
    "paises bajos": "NL",
    "netherlands": "NL",
    "panama": "PA",
    "peru": "PE",
    "puerto rico": "PR",
    "reino unido": "GB",
    "uk": "GB",
    "united kingdom": "GB",
    "gran bretana": "GB",
    "romania": "RO",
    "suecia": "SE",
    "suiza": "CH",
    "switzerland": "CH",
    "uruguay": "UY",
    "germany": "DE",
    "france": "FR",
    "norway": "NO",
    "sweden": "SE",
    "denmark": "DK",
    "republic of korea": "KR",
    "tegucigalpa": "HN",
    "francisco morazan": "HN",
    "san pedro sula": "HN",
    "sps": "HN",
    "danli": "HN",
    "comayaguela": "HN",
    "comayagua": "HN",
    "olancho": "HN",
    "zamorano": "HN",
    "ceiba": "HN",
    "boston": "US",
    "chicago": "US",
    "new york": "US",
    "washington": "US",
}

#: Beginnings of names that one pattern looks for; names that share one are told apart by a join.
BEGINNINGS = 4096
#: Characters of the longest beginning.
LONGEST_BEGINNING = 16

INSIDE_WORD = r"[\p{L}\p{N}]"


def by_length(places: Mapping[str, str]) -> list[tuple[str, str]]:
    """Longest name first; names of equal length keep their order."""
    return sorted(places.items(), key=lambda item: -len(item[0]))


def lookup(folded: Column, places: Mapping[str, str] = PLACES, word_boundary=False) -> Column:
    """Code of the first name found in an already folded text; null when none occurs."""
    ordered = by_length(places)

    def hit(name: str) -> Column:
        if word_boundary:
            return folded.rlike(rf"(?<!{INSIDE_WORD})\Q{name}\E(?!{INSIDE_WORD})")
        return folded.contains(name)

    return F.coalesce(*[F.when(hit(name), F.lit(code)) for name, code in ordered])


def with_country_code(
    df: DataFrame,
    column: str,
    output: str = "pais_codigo",
    places: Mapping[str, str] = PLACES,
    word_boundary: bool = False,
) -> DataFrame:
    """Adds the code of the country named in ``column``; the text is folded once per row."""
    folded = "__plegado"
    return (
        df.withColumn(folded, text.fold_text(F.col(column).cast("string")))
        .withColumn(output, lookup(F.col(folded), places, word_boundary))
        .drop(folded)
    )


def _trie_pattern(words: Iterable[str]) -> str:
    """One alternation over the words, a branch for each next character."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def told(node: dict) -> str:
        if "" in node:  # what begins here is looked up by all its lengths
            return ""
        branches = [f"\\x{{{ord(c):x}}}{told(below)}" for c, below in sorted(node.items())]
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return told(root)


@dataclass(frozen=True)
class NameIndex:
    """``pattern`` finds every place where a name may begin, with as many characters as names have;
    names begin with their first ``longest`` characters, or are shorter: ``sizes`` are the lengths of
    these beginnings."""

    pattern: str
    sizes: tuple[int, ...]
    longest: int


def name_index(names: DataFrame, word_boundary: bool = False) -> NameIndex | None:
    """Index over the beginnings of ``nombre``; None without names.

    As many characters are taken as leave about ``BEGINNINGS`` different beginnings, so the index has
    the same size for any number of names. Only beginnings come to the driver.
    """
    spans = range(1, LONGEST_BEGINNING + 1)
    seen = names.agg(
        F.max(F.length("nombre")).alias("most"),
        *[F.approx_count_distinct(F.left("nombre", F.lit(k))).alias(f"n{k}") for k in spans],
    ).first()
    if seen["most"] is None:
        return None
    longest = max([k for k in spans if seen[f"n{k}"] <= BEGINNINGS], default=1)
    found = [r[0] for r in names.select(F.left("nombre", F.lit(longest))).distinct().collect()]
    before = f"(?<!{INSIDE_WORD})" if word_boundary else ""
    pattern = f"(?s){before}(?=({_trie_pattern(found)}.{{0,{seen['most'] + 1}}}))"
    # A beginning that another one continues stands for both: the pattern stops at the shorter one.
    return NameIndex(pattern, tuple(sorted({len(w) for w in found})), longest)


def places_of_names(texts: DataFrame, index: NameIndex) -> DataFrame:
    """(__texto, __resto): a row for each place of a text (``__plegado``) where a name may begin."""
    hits = F.regexp_extract_all("__plegado", F.lit(index.pattern), F.lit(1))
    return texts.select("__texto", F.explode(hits).alias("__resto"))


def with_country_code_from(
    df: DataFrame,
    column: str,
    gazetteer: DataFrame,
    output: str = "pais_codigo",
    word_boundary: bool = False,
) -> DataFrame:
    """Same look-up with a gazetteer table (nombre, codigo, pos), names already folded.

    ``pos`` breaks ties between names of equal length. Entries without a name or a code are no
    names; of entries with one name the first by ``pos`` counts. Distinct folded texts are searched
    once, by a pattern over the beginnings of all names: only places where a name may begin become
    rows. A beginning tells the lengths of its names, and the places are joined with the whole names.
    The way is the same for any number of names; they are broadcast if they are counted to be few,
    else shuffled. Rows are matched with
    their text by a key of bounded width, so they need no key of their own.
    """
    names = gazetteer.filter((F.col("nombre") != "") & F.col("codigo").isNotNull())
    ranked = materialise(
        names.groupBy("nombre").agg(
            F.min("pos").alias("pos"), F.min_by("codigo", "pos").alias("codigo")
        )
    )
    index = name_index(ranked, word_boundary)
    if index is None:
        return df.withColumn(output, F.lit(None).cast("string"))
    folded = text.fold_text(F.col(column).cast("string"))
    texts = (
        df.select(folded.alias("__plegado"))
        .filter(F.col("__plegado") != "")
        .select(match_key(F.col("__plegado")).alias("__texto"), "__plegado")
        .groupBy("__texto")
        .agg(F.first("__plegado").alias("__plegado"))
    )
    # A place asks for every beginning, and for the whole names of those lengths that its beginning
    # has: names are met by equality, however many share a beginning.
    starts = F.array(*[F.left("__resto", F.lit(k)) for k in index.sizes])
    places = places_of_names(texts, index).select("*", F.explode(F.array_distinct(starts)).alias("__inicio"))
    lengths = materialise(
        ranked.groupBy(F.left("nombre", F.lit(index.longest)).alias("__inicio"))
        .agg(F.collect_set(F.length("nombre")).alias("__largos"))
    )
    lengths = F.broadcast(lengths) if is_small(lengths) else lengths
    asked = (
        places.join(lengths, "__inicio")
        .select("__texto", "__resto", F.explode("__largos").alias("__largo"))
        .filter(F.length("__resto") >= F.col("__largo"))
        .withColumn("nombre", F.expr("left(__resto, __largo)"))
    )
    found = asked.join(F.broadcast(ranked) if is_small(ranked) else ranked, "nombre")
    if word_boundary:
        behind = F.expr("substring(__resto, length(nombre) + 1, 1)")
        found = found.filter(~behind.rlike(INSIDE_WORD))
    best = found.groupBy("__texto").agg(
        F.min_by("codigo", F.struct(-F.length("nombre"), "pos", "nombre")).alias(output)
    )
    keyed_rows = df.withColumn("__texto", match_key(folded))
    return keyed_rows.join(best, "__texto", "left").drop("__texto")


def count_unmatched(df: DataFrame, output: str = "pais_codigo") -> DataFrame:
    """Rows whose country was not recognised, of all rows."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(output).isNull()).alias("sin_pais")
    )
