"""The international numbering plan as ranges of national numbers, looked up by their longest prefix."""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# National numbers by calling code: first digits (a class in brackets stands for one digit), then
# how many digits the whole national number has. The longest prefix decides. From the public E.164
# plans. Fixed values.
RANGES = {
    "1": "[2-9][0-8]\\d[2-9]:10",
    "7": "[346-9]:10",
    "20": "[4-9]:9 1[35]:9 1[0125]:10 2:9 3:8",
    "27": "[1-8]:9",
    "30": "2:10 69:10 [5789]0:10",
    "31": "[1-57]:9 6[1-58]:9 8[08]:7-10 90:7-10",
    "32": "[1-9]:8 4[5-9]:9",
    "33": "[1-9]:9",
    "34": "[5-9]:9",
    "36": "[1-9]:8 [23457]0:9 31:9",
    "39": "0:6-11 3:9-10 [148]:3-10 5:8-10 7:6-10",
    "40": "[237-9]:9",
    "41": "[2-9]:9",
    "44": "[2357-9]:10 1:9-10 800:9-10",
    "45": "[2-9]:8",
    "46": "[1-9]:7-10",
    "47": "[2-9]:8",
    "48": "[1-9]:9",
    "49": "[1-9]:5-14",
    "51": "9:9 [14-8]:8",
    "52": "[2-9]:10",
    "53": "[2-8]:8",
    "54": "[1-3]:10 9:11 [68]0:10",
    "55": "[1-9][1-9][2-5]:10 [1-9][1-9]9:11 [3589]00:10",
    "56": "[2-9]:9",
    "57": "3:10 60[124-8]:10 1[89]00:10-11",
    "58": "2:10 4[12]:10 [589]00:10",
    "60": "1:9-10 3:9 [4-79]:8 8[2-9]:8 1[38]00:10",
    "61": "[2-478]:9 5:9 1[38]00:10 13:6",
    "63": "2:9-10 [3-8]:9 9:10 1800:11-14",
    "64": "[34679]:8 2:8-10 [58]0:8-10",
    "65": "[3689]:8 1800:11",
    "66": "[2-7]:8 [689]:9 1800:10",
    "81": "[1-9]:9 [5-9]0:10 120:9",
    "82": "1:9-10 2:8-9 [3-6]:8-10 70:10 80:8-10",
    "84": "2:10 [35789]:9 1[89]00:8-10",
    "86": "1[3-9]:11 10:10 2:10 [3-9]:10-11",
    "90": "[2-5]:10 [89]00:10 8[15]0:10",
    "91": "[1-9]:10",
    "92": "3:10 [24-9]:9-10",
    "94": "[1-9]:9",
    "98": "[1-9]:10",
    "212": "[5-8]:9",
    "213": "[1-4]:8 [5-7]:9 9:9",
    "216": "[2-57-9]:8",
    "221": "[378]:9",
    "225": "[02]:10",
    "233": "[235]:9 800:8",
    "234": "[1-69]:7-8 [789][01]:10 800:10",
    "237": "[26]:9 88:8",
    "251": "[1-59]:9",
    "254": "[17]:9 [2-6]:7-9 [89]00:9-10",
    "255": "[2678]:9",
    "351": "[236-9]:9",
    "353": "1:8 8[35-9]:9 [24-79]:7-9 1800:10",
    "354": "[4-9]:7 3:9",
    "359": "[2-7]:7-8 8[7-9]:9 9:8-9",
    "370": "[3-9]:8",
    "371": "[2689]:8",
    "372": "[3-7]:7 5[0-9]:7-8 800:7-10",
    "375": "[1-4]:9 80[02]:10",
    "380": "[3-9]:9",
    "385": "[2-5]:8 1:8 9:8-9 800:9",
    "420": "[2-9]:9",
    "421": "[2-59]:9 800:9",
    "501": "[2-8]:7",
    "502": "[2-7]:8",
    "503": "[267]:8",
    "504": "[237-9]:8",
    "505": "[1257-8]:8",
    "506": "[245-8]:8",
    "507": "[1-9]:7 6:8",
    "509": "[2-489]:8",
    "591": "[2-467]:8",
    "593": "9:9 [2-7]:8",
    "595": "9:9 [2-8]:7-9",
    "598": "[249]:8",
    "852": "[2-9]:8",
    "853": "[268]:8",
    "880": "1[3-9]:10",
    "886": "9:9 [2-8]:8-9",
    "965": "[2569]:8 1:7",
    "966": "5:9 1:9 [89]00:10",
    "968": "[279]:8",
    "971": "5[024-8]:9 [2-479]:8",
    "972": "5:9 [23489]:8 7:9",
    "973": "[13679]:8",
    "974": "[3-7]:8",
    "994": "[1-9]:9",
    "995": "[357]:9",
    "998": "[3-9]:9",
}

# The other assigned calling codes: only how many digits national numbers have. From the public
# E.164 plans. Fixed values.
LENGTHS = {
    (3, 12): "43 62",
    (4, 6): "247 290 682 683",
    (4, 12): "352 358",
    (5, 8): "500 676 677 678 685 688 690",
    (6, 6): "298 299 508 672 681 687",
    (6, 9): "252 355 376 689",
    (6, 12): "378 381",
    (7, 7): "220 238 239 246 248 291 297 592 597 673 674 679 680 691 692 960",
    (7, 8): "230 241 267 269 599 670 675 686 975",
    (7, 10): "231 243 245 263 265 423 95 882 883",
    (8, 8): "222 223 224 226 227 228 232 235 236 253 257 266 350 356 357 373 374 377 386 389 800 808 976 993",
    (8, 9): "250 258 264 268 382 383 387 855 961 962 963 967 970",
    (8, 10): "229 850 856 964 977 996",
    (9, 9): "93 211 218 240 242 244 249 256 260 261 262 590 594 596 881 979 992",
    (9, 12): "870 878 888",
}

# Calling codes whose national numbers may be written with a leading trunk zero. Fixed values.
TRUNK_ZERO = frozenset(
    "20 27 31 33 40 41 43 44 46 48 49 51 54 55 57 58 60 61 62 63 64 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 "
    "218 233 234 243 249 250 251 254 255 256 260 263 264 353 355 358 359 370 373 374 380 381 382 383 385 386 387 "
    "389 421 593 595 598 855 856 880 886 961 962 963 964 966 967 970 971 972 976 977 992 994 995 996".split()
)

# What a number was judged by.
BY_RANGE = "rango nacional"
BY_LENGTH = "solo longitud"

PLAN_SCHEMA = "prefijo string, codigo string, minimo int, maximo int, criterio string"

Range = tuple[str, int, int]


@lru_cache(maxsize=None)
def national_ranges() -> dict[str, tuple[Range, ...]]:
    """Calling code -> (first digits as a pattern, least and greatest number of national digits)."""
    found: dict[str, tuple[Range, ...]] = {}
    for (low, high), codes in LENGTHS.items():
        found.update({code: (("", low, high),) for code in codes.split()})
    for code, told in RANGES.items():
        items = []
        for item in told.split():
            first, _, sizes = item.partition(":")
            low, _, high = sizes.partition("-")
            items.append((first.replace("\\d", "[0-9]"), int(low), int(high or low)))
        found[code] = tuple(items)
    return found


def _digits(first: str) -> list[str]:
    """The digits that each place of a range's first digits may have."""
    places = []
    for part in re.findall(r"\[[^]]*\]|\d", first):
        spans = re.findall(r"(\d)(?:-(\d))?", part)
        places.append("".join(str(d) for a, b in spans for d in range(int(a), int(b or a) + 1)))
    return places


def national_pattern(code: str) -> str:
    """Pattern of the national numbers of a code; ranges with longer first digits exclude the others."""
    items = sorted(national_ranges()[code], key=lambda r: -len(_digits(r[0])))
    # A shorter range does not take numbers that begin like a longer one.
    branches, longer = [], []
    for first, low, high in items:
        k = len(_digits(first))
        before = "".join(f"(?!{other})" for other, size in longer if size > k)
        branches.append(f"{before}{first}\\d{{{low - k},{high - k}}}")
        longer.append((first, k))
    trunk = "0?(?!0)" if code in TRUNK_ZERO else "1?" if code == "1" else ""
    return f"{trunk}(?:{'|'.join(branches)})"


def plan_rows() -> list[tuple[str, str, int | None, int | None, str | None]]:
    """The plan by prefixes of the international number, lengths counted with the calling code.

    A calling code has a row of its own without lengths, for numbers in none of its ranges. Trunk
    digits are part of prefixes of their own.
    """
    rows: dict[str, tuple] = {}
    for code, items in national_ranges().items():
        trunks = ["", "0"] if code in TRUNK_ZERO else ["", "1"] if code == "1" else [""]
        rows[code] = (code, code, None, None, None)
        if "0" in trunks:  # no national number begins with the trunk digit
            rows[f"{code}00"] = (f"{code}00", code, None, None, None)
        for trunk, (first, low, high) in itertools.product(reversed(trunks), items):
            basis, extra = BY_RANGE if first else BY_LENGTH, len(code) + len(trunk)
            for digits in itertools.product(*_digits(first)):
                prefix = code + trunk + "".join(digits)
                rows[prefix] = (prefix, code, low + extra, high + extra, basis)
    return list(rows.values())


def default_plan(spark: SparkSession) -> DataFrame:
    """The plan as a table (prefijo, codigo, minimo, maximo, criterio); more rows may be added to it."""
    return spark.createDataFrame(plan_rows(), PLAN_SCHEMA)
