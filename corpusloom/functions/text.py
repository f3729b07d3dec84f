"""Text cleaning as column expressions; the two vectorized helpers are marked.

Rule tables (acronyms, repairs, document classes) are arguments with defaults from the domain of satellite data.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Acronyms and their expansions, applied in this order.
ACRONYMS = {
    "TPW": "Total Precipitable Water",
    "MJO": "Madden-Julian Oscillation",
    "SST": "Sea Surface Temperature",
    "OLR": "Outgoing Longwave Radiation",
    "SWH": "Significant Wave Height",
    "INSAT": "Indian National Satellite System",
    "SCATSAT": "Scatterometer Satellite",
    "IMD": "India Meteorological Department",
    "ISRO": "Indian Space Research Organisation",
    "VHRR": "Very High Resolution Radiometer",
}
# Document classes and the words that show them; the first class that matches wins.
DOCUMENT_TYPES = {
    "faq": ["question", "answer", "faq", "frequently asked"],
    "report": ["report", "study", "analysis"],
    "technical": ["specification", "technical", "user manual"],
}
# Latin strings that stand for Devanagari ones after a bad OCR, replaced in this order.
OCR_REPAIRS = {"qr": "क", "qrf": "क्र", "T{": "भा", "ffi": "ति", "z": "्य", "t": "र", "f": "ी", "r": "ा"}
# Consonants that a blank parts from the one they join, replaced in this order.
CONJUNCTS = {"क र": "क्र", "त र": "त्र", "द र": "द्र", "न र": "न्र", "प र": "प्र", "म र": "म्र"}
#: Host names that a bad OCR misspells.
URL_REPAIRS = {".qov.in": ".gov.in"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_DATES = re.compile(rf"\b(\d{{1,2}})(?:(?:th|st|nd|rd)\s+({'|'.join(MONTHS)})[a-z]*\s+|([-/])(\d{{1,2}})[-/])(\d{{4}})\b", re.IGNORECASE)


@pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Vectorized helper: compatibility composition, which Spark lacks."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def strip_artifacts(text: Column) -> Column:
    """Drops control, format and odd space characters except newline, tab and blank; splits two ligatures."""
    clean = F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ \n\t]]", "")
    return F.replace(F.replace(clean, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))


def iso_date(value: Column) -> Column:
    """A date column written day first, with slashes or dashes, as yyyy-MM-dd; anything else stays as it is."""
    parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in ("d/M/yyyy", "d-M-yyyy")])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), value)


def _iso(m: re.Match) -> str:
    month = MONTHS.index(m[2].lower()) + 1 if m[2] else int(m[4])
    try:
        return date(int(m[5]), month, int(m[1])).isoformat()
    except ValueError:
        return m[0]


@pandas_udf(T.StringType())
def dates_in_text(text: pd.Series) -> pd.Series:
    """Vectorized helper: dates such as 15th Jan 2024 or 15/01/2024 inside a text become ISO; invalid ones stay."""
    return text.map(lambda t: _DATES.sub(_iso, t), na_action="ignore")


def expand_acronyms(text: Column, acronyms: dict[str, str] | None = None) -> Column:
    """Appends "(expansion)" to each acronym that no parenthesis follows yet.

    A hyphen ends a word, so INSAT in INSAT-3D is expanded too; entities are therefore searched in unexpanded text.
    """
    rules = ACRONYMS if acronyms is None else acronyms
    return reduce(lambda c, kv: F.regexp_replace(c, rf"\b{re.escape(kv[0])}\b(?!\s*\()", f"{kv[0]} ({kv[1]})"), rules.items(), text)


def normalize_whitespace(text: Column) -> Column:
    """One blank for blanks within a line, at most one empty line, nothing at the ends."""
    lines = F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def normalize_text(text: Column, acronyms: dict[str, str] | None = None) -> Column:
    return normalize_whitespace(expand_acronyms(dates_in_text(strip_artifacts(nfkc(text))), acronyms))


def cleaned_text(text: Column) -> Column:
    """As normalize_text but without expansions: the text in which entities are searched."""
    return normalize_whitespace(dates_in_text(strip_artifacts(nfkc(text))))


def devanagari_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^ऀ-ॿ]", "")) / F.greatest(F.length(text), F.lit(1))


def is_devanagari(text: Column, share: float = 0.3) -> Column:
    return F.coalesce(devanagari_share(text) > share, F.lit(False))


def repair(text: Column, rules: dict[str, str]) -> Column:
    """Ordered literal replacements."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), rules.items(), text)


def repair_ocr(text: Column, language: Column, only: str = "hi", rules: dict[str, str] | None = None, urls: dict[str, str] | None = None) -> Column:
    """Repairs texts of one language: ordered replacements, signs and consonants that a blank parted, and misspelt hosts."""
    signs = F.regexp_replace(repair(text, OCR_REPAIRS if rules is None else rules), r"([ा-ृ])\s+(्)", "$1$2")
    joined = repair(F.regexp_replace(signs, r"([क-ह])\s+([ा-ौ])", "$1$2"), CONJUNCTS)
    return F.when(language == only, repair(joined, URL_REPAIRS if urls is None else urls)).otherwise(text)


def repair_decoding(text: Column, char: str = "°") -> Column:
    return F.replace(text, F.lit("�"), F.lit(char))


def first_class(text: Column, classes: dict[str, list[str]], otherwise: Column) -> Column:
    """The first class with a pattern that a text holds, whatever the case."""
    out = None
    for name, patterns in classes.items():
        hit = F.lower(text).rlike("|".join(p.lower() for p in patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return otherwise if out is None else out.otherwise(otherwise)


def document_type(text: Column, classes: dict[str, list[str]] | None = None) -> Column:
    return first_class(text, DOCUMENT_TYPES if classes is None else classes, F.lit("other"))
