"""Text cleaning and labelled-field extraction over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the documents' own scripting language, and the labels
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LABEL_REGISTERED = "შემოსვლის თარიღი"
LABEL_ISSUED = "გაცემის თარიღი"
LABEL_RESULT = "შედეგი"
LABEL_NOMENCLATURE = "ნომენკლატურა"
CODE_PATTERN = r"\d{2}\.\d{2}\.\d{2}\.\d{3}\.\d{3}"
DATE_AFTER_LABEL = r"[^0-9]{0,20}(\d{1,2}[/.]\d{1,2}[/.]\d{4})"
WORD_AFTER_LABEL = rf"{SPACE}*:?{SPACE}*([ა-ჰ]+)"
PDF_SIGNATURE = "25504446"
NOMENCLATURE_FIELD = r'nomenklaturMarkup:"([^"\\]*+(?:\\[^\n\r\x{2028}\x{2029}][^"\\]*+)*+)"'

_ANY_TAG = r"<[^>]+>"
# Cheap tests that a match can start here at all; the full white-space class is slow to try at every letter.
_MAY_BE_SPACE = r"(?=[\t\n\x0B\f\r \xA0\x{1680}-\x{FEFF}])"
_MAY_BE_GAP = r"(?=[<&\t\n\x0B\f\r \xA0\x{1680}-\x{FEFF}])"


def strip_tags(text: Column, replacement: str = " ") -> Column:
    return F.regexp_replace(text, _ANY_TAG, replacement)


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{_MAY_BE_SPACE}{SPACE}+", " ")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{_MAY_BE_SPACE}{SPACE}+$", "")


def plain_text(html: Column) -> Column:
    """Runs of tags, ``&nbsp;`` and white space become one space, in a single pass."""
    return F.regexp_replace(html, f"{_MAY_BE_GAP}(?:{_ANY_TAG}|&[nN][bB][sS][pP];|{SPACE})++", " ")


def labelled_date(text: Column, label: str) -> Column:
    """First ``d/m/yyyy`` or ``d.m.yyyy`` within 20 non-digits of the label, or ``''``."""
    return F.replace(F.regexp_extract(text, label + DATE_AFTER_LABEL, 1), F.lit("."), F.lit("/"))


def labelled_word(text: Column, label: str) -> Column:
    """First Georgian-letter word after the label and an optional colon, or ``''``."""
    return F.regexp_extract(text, label + WORD_AFTER_LABEL, 1)


def property_codes(text: Column) -> Column:
    """Distinct property codes in the order they first appear."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CODE_PATTERN), F.lit(0)))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def is_pdf(body: Column) -> Column:
    return F.hex(F.substring(body, 1, 4)) == PDF_SIGNATURE


def base64_text(body: Column) -> Column:
    """Base64 without line breaks (Spark may cut it into lines)."""
    return F.translate(F.base64(body), "\r\n", "")


def unescape_markup(escaped: Column) -> Column:
    r"""Undo ``\uXXXX``, ``\/``, ``\n`` (to a space) and ``\"``; other escapes stay as written.

    The code points are decoded by the JSON reader, with every other backslash and quote
    protected first.
    """
    protected = F.regexp_replace(escaped, r"\\(?!u[0-9a-fA-F]{4})", r"\\\\")
    protected = F.replace(protected, F.lit('"'), F.lit('\\"'))
    decoded = F.from_json(
        F.concat(F.lit('["'), protected, F.lit('"]')),
        "array<string>",
        {"allowUnquotedControlChars": "true"},
    )
    text = F.try_element_at(decoded, F.lit(1))
    text = F.replace(text, F.lit("\\/"), F.lit("/"))
    text = F.replace(text, F.lit("\\n"), F.lit(" "))
    return F.replace(text, F.lit('\\"'), F.lit('"'))


def list_items(markup: Column) -> Column:
    """Text of each list item, tags removed and trimmed, empty items dropped."""
    found = F.regexp_extract_all(markup, F.lit(r"(?i)<li>([^\n\r\x{2028}\x{2029}]*?)</li>"), F.lit(1))
    cleaned = F.transform(found, lambda item: trim_space(strip_tags(item, "")))
    return F.filter(cleaned, lambda item: item != "")


def nomenclature_markup(raw: Column) -> Column:
    """The unescaped nomenclature markup of a permit reply, null when it has none."""
    captured = F.regexp_extract_all(raw, F.lit(NOMENCLATURE_FIELD), F.lit(1))
    return unescape_markup(F.try_element_at(captured, F.lit(1)))


def unlisted_nomenclature(markup: Column) -> Column:
    """The stripped text of markup without list items, its label removed once."""
    text = F.regexp_replace(markup, f"{_MAY_BE_GAP}(?:{_ANY_TAG}|{SPACE})++", " ")
    unlabelled = F.regexp_replace(text, f"(?s)^(.*?){LABEL_NOMENCLATURE} ?: ?(.*)$", "$1$2")
    return F.trim(F.when(F.contains(text, F.lit(LABEL_NOMENCLATURE)), unlabelled).otherwise(text))
