"""Column functions for text cells and missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value, as they are written where case counts.
EXACT_NULL_TOKENS = [
    "nan", "NaN", "NA", "N/A", "n/a", "na", "null", "NULL", "Null", "none", "NONE", "None", "", " ", "-", "--", "?",
    "unknown", "UNKNOWN", "Unknown", "UNK", "undefined", "UNDEFINED", "Undefined", "missing", "MISSING", "Missing", "MISS",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "nil", "NIL",
    "(null)", "[null]", "{null}", "<null>", "(empty)", "[empty]", "{empty}", "<empty>",
    "not available", "Not Available", "NOT AVAILABLE", "not applicable", "Not Applicable", "NOT APPLICABLE",
    "to be determined", "To Be Determined", "TBD", "tbd", "not specified", "Not Specified", "NOT SPECIFIED",
    "not provided", "Not Provided", "NOT PROVIDED", "\\N", "\n", "\r", "\t", "void", "VOID", "Void", "blank", "BLANK", "Blank",
    "empty", "EMPTY", "Empty", "0", "0.0", "0.00", "false", "FALSE", "False", "no value", "NO VALUE", "No Value",
    "no data", "NO DATA", "No Data",
]
#: The same tokens compared without regard to case.
NULL_TOKENS = list(dict.fromkeys(t.lower() for t in EXACT_NULL_TOKENS))
#: The tokens of the short report, case counts.
REPORT_TOKENS = ["nan", "NaN", "NA", ""]
#: Whole cells that duplicate detection takes for a missing value, case doesn't count.
DUPLICATE_NULLS = ["nan", "null", "none", "na", "n/a", ""]
#: Fixed value: punctuation that duplicate detection ignores.
IGNORED_MARKS = r"""[,.'"\-_()\[\]{}]"""
#: What a text that is a number looks like.
NUMBER = r"^[ \t\n\r\f\v]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f\v]*$"


def strip(c: Column) -> Column:
    """Without white space at both ends; ``trim`` would take off spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_null(c: Column, kind: T.DataType) -> Column:
    """NULL, or NaN where the type has it."""
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def is_missing(c: Column, kind: T.DataType) -> Column:
    """NULL, NaN, or for text a null token or nothing but white space."""
    if not isinstance(kind, T.StringType):
        return is_null(c, kind)
    return F.coalesce(F.lower(c).isin(NULL_TOKENS) | (strip(c) == ""), F.lit(True))


def detected_as(c: Column, kind: T.DataType) -> Column:
    """Why a cell that is missing counts as missing."""
    if not isinstance(kind, T.StringType):
        return F.when(c.isNull(), "None").otherwise("NaN")
    return (
        F.when(c.isNull(), "None").when(strip(c) == "", "Empty string")
        .when(c.isin(EXACT_NULL_TOKENS), F.concat(F.lit("Null indicator: "), c)).otherwise("Missing")
    )


def to_number(c: Column) -> Column:
    """The number that a text is; NULL where it isn't one (a cast alone takes ``7d`` for 7)."""
    return F.when(c.rlike(NUMBER), strip(c).try_cast("double"))


def normalised(c: Column, *, case_sensitive: bool = False, ignore_whitespace: bool = True) -> Column:
    """A text cell as duplicate detection compares it."""
    out = F.when(c.isNull() | F.lower(c).isin(DUPLICATE_NULLS), "NULL").otherwise(c)
    if not case_sensitive:
        out = F.lower(out)
    if ignore_whitespace:
        out = F.regexp_replace(F.regexp_replace(strip(out), r"(?U)\s+", " "), IGNORED_MARKS, "")
    return out


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """``part`` of ``whole`` in percent; 0 of nothing."""
    share = F.when(whole > 0, part.cast("double") / whole * 100).otherwise(F.lit(0.0))
    return share if digits is None else F.round(share, digits)
