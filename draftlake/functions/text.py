"""Text functions over columns: format codes, escapes, names, versions. All built-ins and higher-order functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Group codes whose parameter runs to the next semicolon, and what %% codes stand for.
MTEXT_PARAMETER_CODES = "ACcFfHLlOoQSTW"
PERCENT_CODES = {"c": "φ", "d": "°", "p": "±", "%": "%", "u": "", "o": ""}
#: Version strings by age.
VERSIONS = {
    "AC1006": "R10", "AC1009": "R11", "AC1012": "R13", "AC1014": "R14", "AC1015": "R2000",
    "AC1018": "R2004", "AC1021": "R2007", "AC1024": "R2010", "AC1027": "R2013", "AC1032": "R2018",
}
MAX_NAME = 80


def strip_mtext(text: Column) -> Column:
    """Plain text of a formatted text: \\P is a new line, \\~ a space, codes with a parameter and braces go."""
    token = rf"(?s)(\\[{MTEXT_PARAMETER_CODES}][^;]*;?|\\.|[{{}}]|[^\\{{}}]+|\\)"

    def plain(t: Column) -> Column:
        code = F.substring(t, 2, 1)
        return (
            F.when(t.isin("{", "}", "\\"), "")
            .when(~t.startswith("\\"), t)
            .when(code == "P", "\n")
            .when(code.isin("~", "X"), " ")
            .when(code == "\\", "\\")
            .otherwise("")
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(1)), plain), "")


def expand_percent(text: Column) -> Column:
    """%%c, %%d and %%p as their signs, %%% as one percent sign, %%u and %%o dropped; a last %% is one percent sign."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(%%[cCdDpPuUoO%]|%%|%|[^%]+)"), F.lit(1))

    def sign(n: Column):
        def one(t: Column, i: Column) -> Column:
            out = F.when((t == "%%") & (i == n - 1), "%")
            for code, value in PERCENT_CODES.items():
                out = out.when(F.lower(t) == "%%" + code, value)
            return out.otherwise(t)

        return one

    return F.array_join(F.transform(tokens, sign(F.size(tokens))), "")


def expand_unicode(text: Column) -> Column:
    """\\U+XXXX as the character it names (basic plane)."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(\\U\+[0-9A-Fa-f]{4}|\\|[^\\]+)"), F.lit(1))

    def one(t: Column) -> Column:
        raw = F.unhex(F.substring(t, 4, 4))
        return F.when(t.rlike(r"^\\U\+[0-9A-Fa-f]{4}$"), F.decode(raw, "UTF-16BE")).otherwise(t)

    return F.array_join(F.transform(tokens, one), "")


def sanitize_name(name: Column) -> Column:
    """A sheet name fit for a file: white space and reserved characters as one dash, controls dropped, 80 characters."""
    dashed = F.regexp_replace(name, r'[\s/\\:*?"<>|]+', "-")
    clean = F.regexp_replace(F.regexp_replace(dashed, r"[\x00-\x1F\x7F]", ""), "-{2,}", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(clean, r"^[-.]+|[-.]+$", ""), 1, MAX_NAME), r"[-.]+$", "")
    return F.when(cut == "", "sheet").otherwise(cut)


def dxf_unquote(text: Column) -> Column:
    """Caret escapes: ^J, ^M, ^I and caret-space for the caret itself."""
    out = F.replace(F.replace(F.replace(text, F.lit("^J"), F.lit("\n")), F.lit("^M"), F.lit("\r")), F.lit("^I"), F.lit("\t"))
    return F.replace(out, F.lit("^ "), F.lit("^"))


def dxf_sanitize(text: Column) -> Column:
    """Line breaks as caret escapes, so that a value stays on one line."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("^M")), F.lit("\n"), F.lit("^J"))


def xml_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_sheet_number(text: Column) -> Column:
    return F.trim(text).rlike(r"^[A-Z]{1,6}(?:\([A-Z]{1,4}\))?-\d{1,3}$")


def is_cjk_name(text: Column) -> Column:
    """At least four Han characters, and more than half of what is not white space."""
    han = F.length(F.regexp_replace(text, r"[^\p{IsHan}]", ""))
    return (han >= 4) & (han * 2 > F.length(F.regexp_replace(text, r"\s", "")))


def is_readable(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{Nd}]")


def version_name(code: Column) -> Column:
    """The release of a version string; unknown ones count as the newest."""
    out = F.lit(None).cast("string")
    for k, v in VERSIONS.items():
        out = F.when(code == k, v).otherwise(out)
    return F.coalesce(out, F.lit("R2018"))


def codepage(name: Column) -> Column:
    """Numeric code page of a DXF name: ANSI_125x by offset, the Chinese pages as 31, else 30."""
    digits = F.regexp_extract(name, r"(\d+)$", 1).try_cast("int")
    return F.when(F.upper(name).rlike("936|GBK|GB2312"), 31).when(digits.between(1250, 1258), digits - 1222).otherwise(30)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def group_value_type(code: Column) -> Column:
    """Value type of a DXF group code. The ranges."""
    ranges = (
        (0, 9, "string"), (10, 59, "double"), (60, 79, "int16"), (90, 99, "int32"), (100, 102, "string"), (105, 105, "handle"),
        (110, 149, "double"), (160, 169, "int64"), (170, 179, "int16"), (210, 239, "double"), (270, 289, "int16"), (290, 299, "bool"),
        (300, 309, "string"), (310, 319, "binary"), (320, 369, "handle"), (370, 389, "int16"), (390, 399, "handle"), (400, 409, "int16"),
        (410, 419, "string"), (420, 429, "int32"), (430, 439, "string"), (440, 449, "int32"), (450, 459, "int32"), (460, 469, "double"),
        (470, 481, "string"), (999, 1009, "string"), (1010, 1059, "double"), (1060, 1070, "int16"), (1071, 1071, "int32"),
    )
    out = F.lit("string")
    for a, b, kind in ranges:
        out = F.when(code.between(a, b), kind).otherwise(out)
    return out


def class_name_score(name: Column) -> Column:
    """How much a decoded class name looks like one. The weights of kinds of characters."""
    kinds = (("[A-Z0-9]", 4), ("[_$*]", 2), ("[a-z]", 1), (r"[\x00-\x1F]", -12))
    total = sum((F.regexp_count(name, F.lit(k)) * w for k, w in kinds), F.lit(0))
    other = F.regexp_count(name, F.lit(r"[^A-Za-z0-9_$*\x00-\x1F]")) * -4
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, -16).otherwise(total + other)


#: Drawing code pages that are Latin-1 or GBK; others are read as UTF-8.
LATIN_PAGES, GBK_PAGES = (2, 11, 12, 30), (31, 39)


def codec(page: int | None) -> str:
    return "latin-1" if page in LATIN_PAGES else "gbk" if page in GBK_PAGES else "utf-8"


def _decoded(raw: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else bytes(b).decode(codec(p), "replace") for b, p in zip(raw, page)])


def decode_codepage(raw: Column | str, page: Column | str) -> Column:
    """Bytes as text by the drawing's code page. The JVM's GBK decoder is closed to SQL by default, so this is Arrow-batched."""
    return F.pandas_udf(_decoded, "string")(raw, page)
