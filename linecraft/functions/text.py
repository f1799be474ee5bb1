"""String column expressions: cleaning, tokenising, display text and file names.

All are built-in Spark expressions (JVM side, whole-stage codegen) except the Unicode
normalisation step of :func:`safe_file_name`, which Spark lacks and which runs as an
Arrow-batched pandas UDF.
"""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------------------

# Python's str.isspace() set, i.e. what `\s` and `str.split()` treat as whitespace, as the
# body of a regex character class. Written with \x{...} escapes, which Java and RE2 share.
WS_CLASS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# The same set as Python characters (for driver-side helpers and tests), built by rule.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Line boundaries of Python's str.splitlines(): \r\n counts as one break.
LINE_BREAK_RE = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
# Default alphabet of the corpus builder (Sorani Kurdish letters and Arabic-Indic digits).
DEFAULT_ALPHABET = "٠١٢٣٤٥٦٧٨٩ئبپتجچحخدرڕزژسشعغفڤقکگلڵمنهاەوۆوویێء"
# Punctuation removed by the cleaner: ASCII punctuation, Arabic comma, Arabic date
# separator, Arabic semicolon, Arabic question mark, the two guillemets, U+06D6, the
# hyphen-minus, U+06ED (the reference writes "U+06D6-U+06ED" as three characters) and
# backslash.
PUNCTUATION = string.punctuation + "\u060c\u060d\u061b\u061f\u00bb\u00ab\u06D6-\u06ED\u005c\u00ab\u00bb"
ZWNJ = "\u200c"
# Default numeral unification: ASCII and Persian digits become Arabic-Indic digits.
DEFAULT_DIGIT_MAP = {
    "0123456789": "٠١٢٣٤٥٦٧٨٩",
    "۰۱۲۳۴۵۶۷۸۹": "٠١٢٣٤٥٦٧٨٩",
}

# Alphabet used with the driver's en/fr/de/es fixture tables.
LATIN_RANGES = ("a-z", "A-Z", "0-9")
LATIN_CHARS = "éèêëçàâîïôûùüäößñóíúáÉÈÊËÇÀÂÎÏÔÛÙÜÄÖÑÓÍÚÁ"


# ---------------------------------------------------------------------------------------
# Character-set helpers (plan-time constants).
# ---------------------------------------------------------------------------------------

def class_escape(chars: str) -> str:
    """Escape characters for use inside a regex character class (Java and RE2)."""
    out = []
    for ch in chars:
        if ch in "\\]^-[&":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def expand_ranges(ranges) -> str:
    out = []
    for r in ranges:
        a, b = r[0], r[-1]
        out.extend(chr(c) for c in range(ord(a), ord(b) + 1))
    return "".join(out)


def keep_class(chars: str, ranges=()) -> str:
    """Class body of the allowed characters: escaped chars plus explicit ranges."""
    rng = "".join(f"{class_escape(r[0])}-{class_escape(r[-1])}" for r in ranges)
    return class_escape(chars) + rng


def deletion_set(keep: str, punctuation: str = PUNCTUATION) -> str:
    """Punctuation minus kept characters, as an ordered, duplicate-free string."""
    keep_set = set(keep)
    seen, out = set(), []
    for ch in punctuation:
        if ch not in keep_set and ch not in seen:
            seen.add(ch)
            out.append(ch)
    return "".join(out)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------------------
# Cleaning and tokenising.
# ---------------------------------------------------------------------------------------

def normalise_script(col, mapping: dict | None = None) -> Column:
    """One translate() applying a character map (default: numeral unification)."""
    mapping = DEFAULT_DIGIT_MAP if mapping is None else mapping
    src = "".join(mapping.keys())
    dst = "".join(mapping.values())
    if not src:
        return _c(col)
    return F.translate(_c(col), src, dst)


def keep_only(col, class_body: str) -> Column:
    """Delete every run of characters outside a class, stated positively.

    Concatenating the maximal runs of allowed characters equals deleting the runs of the
    others; the JVM matches a positive class several times faster than its negation.
    """
    return F.array_join(F.regexp_extract_all(_c(col), F.lit(f"[{class_body}]+"), 0), "")


def keep_chars(col, chars: str, ranges=()) -> Column:
    """B1: delete every run of characters outside the alphabet and whitespace."""
    return keep_only(col, keep_class(chars, ranges) + WS_CLASS)


def strip_urls(col) -> Column:
    """B2: delete `http` followed by non-whitespace."""
    return F.regexp_replace(_c(col), f"http[^{WS_CLASS}]+", "")


def strip_punct(col, keep: str = "") -> Column:
    """Delete punctuation characters that are not kept."""
    dels = deletion_set(keep)
    return F.translate(_c(col), dels, "") if dels else _c(col)


def strip_zwnj(col) -> Column:
    """Delete U+200C."""
    return F.replace(_c(col), F.lit(ZWNJ), F.lit(""))


def clean_text(col, chars: str = DEFAULT_ALPHABET, ranges=(), mapping: dict | None = None,
               urls_first: bool = False) -> Column:
    """B5 -> B1 -> B2 -> B3 -> B4 in the reference's order (Q1: URLs after B1)."""
    c = normalise_script(col, mapping)
    if urls_first:
        c = strip_urls(c)
        c = keep_chars(c, chars, ranges)
    else:
        c = keep_chars(c, chars, ranges)
        c = strip_urls(c)
    c = strip_punct(c, chars + expand_ranges(ranges))
    return strip_zwnj(c)


def tokenise(col) -> Column:
    """Split on whitespace runs, no empty tokens."""
    return F.array_remove(F.split(_c(col), f"[{WS_CLASS}]+"), "")


def characters(col) -> Column:
    """The code points of a text, one string each: none of an empty text, null of a null one."""
    c = _c(col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def split_lines(col) -> Column:
    """Lines of a text as Python's splitlines() sees them (empties included)."""
    return F.split(_c(col), LINE_BREAK_RE)


def drop_substring(df, col: str, needle: str = "nan"):
    """Drop null rows and rows containing `needle`."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).contains(needle))


def min_words(col, n: int) -> Column:
    """B16 predicate: strictly more than n whitespace-separated words."""
    return F.size(tokenise(col)) > F.lit(n)


def py_strip(col) -> Column:
    """Python str.strip(): trim the whole isspace() set, not only blanks."""
    return F.regexp_replace(_c(col), f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


# ---------------------------------------------------------------------------------------
# Display text and names.
# ---------------------------------------------------------------------------------------

def change_case(col, mode: str | None) -> Column:
    """B9."""
    if mode == "upper":
        return F.upper(_c(col))
    if mode == "lower":
        return F.lower(_c(col))
    return _c(col)


def strip_spaces_if(col, space_width) -> Column:
    """Remove spaces when the space width is 0."""
    sw = space_width if isinstance(space_width, Column) else F.lit(space_width)
    return F.when(sw == 0, F.replace(_c(col), F.lit(" "), F.lit(""))).otherwise(_c(col))


def reverse_words(col) -> Column:
    """Words in reverse order (right-to-left display)."""
    return F.array_join(F.reverse(F.split(_c(col), " ")), " ")


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def _nfkd_ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else
                 unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))


nfkc = F.pandas_udf(_nfkc, StringType())
nfkd_ascii = F.pandas_udf(_nfkd_ascii, StringType())

# Python's `\w` for str patterns: letters, numbers and underscore (marks are not word chars).
NAME_CHARS = r"\p{L}\p{N}_" + WS_CLASS + r"\-"
NOT_NAME_CHAR = "[^" + NAME_CHARS + "]"


def safe_file_name(col, allow_unicode: bool = True, assume_normalised: bool = False) -> Column:
    """Normalise, keep word characters, whitespace and hyphen, cut to 200 characters.

    ``assume_normalised`` skips the Python normalisation step for text already in NFKC
    (keeps the whole expression on the JVM).
    """
    c = _c(col)
    if not assume_normalised:
        c = nfkc(c) if allow_unicode else nfkd_ascii(c)
    return F.substring(keep_only(c, NAME_CHARS), 1, 200)


def sample_name(text, index, name_format=0, space_width=1.0, allow_unicode: bool = True,
                assume_normalised: bool = False) -> Column:
    """B14 (+B10, B13): base name of a sample; formats 0 text_index, 1 index_text, 2 index."""
    t = strip_spaces_if(text, space_width)
    i = _c(index).cast("string")
    fmt = name_format if isinstance(name_format, Column) else F.lit(name_format)
    raw = (F.when(fmt == 1, F.concat(i, F.lit("_"), t))
           .when(fmt == 2, i)
           .otherwise(F.concat(t, F.lit("_"), i)))
    return safe_file_name(raw, allow_unicode, assume_normalised)


def sibling_names(name) -> dict:
    """Names of the optional outputs next to an image."""
    n = _c(name)
    return {
        "mask_name": F.concat(n, F.lit("_mask.png")),
        "box_name": F.concat(n, F.lit("_boxes.txt")),
        "tess_box_name": F.concat(n, F.lit(".box")),
    }


def numbered_name(idx, ext: str = "jpg") -> Column:
    """Zero-padded 8-digit name; widens past 10^8 rather than cutting."""
    return F.format_string(f"%08d.{ext}", _c(idx).cast("long"))
