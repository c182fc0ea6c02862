"""Text expressions: whitespace, truncation, markup removal, tokens, slugs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wiregrid.functions.references import decode_references

# Character classes for "space" and "word character" over all of Unicode.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"

# Noncharacters that stand for characters of a text with markup while it is read: "&" inside script
# text, which holds no entities; and "<" where it opens a tag whose quotes lead to no end (NO_QUOTES),
# a comment, script or style without an end (NO_BODY), or both.
_SHIELD, _NO_QUOTES, _NO_BODY, _NEITHER = "﷐", "﷑", "﷒", "﷓"
_OPEN = f"[<{_NO_QUOTES}{_NO_BODY}{_NEITHER}]"
_BODY = f"[<{_NO_QUOTES}]"  # may open what has a body
_QUOTING = f"[<{_NO_BODY}]"  # may open a tag with quotes

# The repeated group of quoted attributes is possessive: a greedy one recurses once per attribute.
_TAG = _QUOTING + r"""/?[a-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
# One alternative per kind of HTML lexeme; the last two are text.
_LEXEME = "|".join(
    [
        _BODY + r"!--.*?-->",
        _BODY + r"script\b[^>]*>.*?" + _BODY + r"/script[^>]*>",
        _BODY + r"style\b[^>]*>.*?" + _BODY + r"/style[^>]*>",
        _TAG,
        _OPEN + r"[/a-z!?][^>]*>",
        _OPEN + r"[/a-z!?][^>]*\z",
        f"[^{_OPEN[1:-1]}]+",
        _OPEN,
    ]
)
HTML_LEXEME = f"(?is){_LEXEME}"
RAW_TEXT_OPEN = rf"(?is)^{_BODY}(?:script|style)\b[^>]*>"
RAW_TEXT = rf"(?is)^{_BODY}(script|style)\b[^>]*>(.*?){_BODY}/\1[^>]*>\z"
MARKUP_OPEN = rf"(?is)^{_OPEN}[/a-z!?]"
# From the start over whole tags to the first one whose quotes lead to no end.
_WALK = rf"(?is)^(?:[^{_QUOTING[1:-1]}]++|{_TAG}|{_QUOTING}(?!/?[a-z]))*+"
_QUOTED = r"""(?s)"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^"']++"""

# Entities decoded without leaving the JVM, in order; "amp" must stay last.
ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "#39": "'",
    "nbsp": "\u00a0",
    "copy": "©",
    "reg": "®",
    "middot": "·",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "hellip": "…",
    "euro": "€",
    "trade": "™",
    "amp": "&",
}
_OTHER_ENTITY = "&(?!(?:" + "|".join(ENTITIES) + ");)[#a-zA-Z]"


def collapse_spaces(text: Column) -> Column:
    """Every run of whitespace becomes one space; none at either end."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}++\z", "")


def truncate(text: Column, limit: int) -> Column:
    """At most `limit` characters, ending in three dots when something was cut."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit <= 3:
        return F.substring(text, 1, limit)
    cut = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def words(text: Column) -> Column:
    """Lower-case word tokens in order of appearance."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token sets; two empty sets have similarity 0."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def text_similarity(left: Column, right: Column) -> Column:
    return jaccard(word_set(left), word_set(right))


def _ascii_fold(text: Column) -> Column:
    def fold(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"),
            na_action="ignore",
        )

    return F.pandas_udf(fold, StringType())(text)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _decode_common(text: Column) -> Column:
    plain = text
    for name, value in ENTITIES.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(value))
    return F.when(text.contains("&"), plain).otherwise(text)


def decode_entities(text: Column, source: Column | None = None) -> Column:
    """Entity references to characters.

    Texts whose `source` (by default the text itself) holds common names only are decoded by plain
    replacements, others reference by reference.
    """
    def decoded(value: Column) -> Column:
        unusual = (value if source is None else source).rlike(_OTHER_ENTITY)
        return F.when(unusual, decode_references(value)).otherwise(_decode_common(value))

    return _bind(text, decoded)


def _after(text: Column, kept: Column, change: Callable[[Column], Column]) -> Column:
    """`text` with what comes after its first `kept` characters changed."""
    return _bind(
        kept,
        lambda k: F.concat(F.left(text, k), change(F.substring(text, k + 1, F.char_length(text)))),
    )


def _raw_marker(name: str) -> Callable[[Column], Column]:
    opening = rf"(?i)<(?={name}\b)"

    def marked(t: Column) -> Column:
        closing = F.regexp_extract(t, r"(?s)^.*>", 0)
        before = F.regexp_extract(closing, rf"(?is)^(.*)</{name}[^>]*>", 1)
        # The opening's own ">" must come before the last closing.
        kept = F.char_length(F.regexp_extract(before, r"(?s)^.*>", 0))
        changed = _after(t, kept, lambda rest: F.regexp_replace(rest, opening, _NO_BODY))
        return F.when(t.rlike(opening), changed).otherwise(t)

    return marked


def _mark_endless(text: Column) -> Column:
    """Openings of comments, scripts and styles that nothing after them closes, marked.

    Whether one is closed follows from the last place of what closes it, found once per text; a
    search from each opening would read on to the end every time.
    """
    marked = text
    for name in ("script", "style"):
        marked = _bind(marked, _raw_marker(name))

    def marked_comments(t: Column) -> Column:
        last = F.char_length(F.regexp_extract(t, r"(?s)^(.*)-->", 1))
        kept = F.when(t.contains("-->"), F.greatest(last - 3, F.lit(0))).otherwise(F.lit(0))
        changed = _after(t, kept, lambda rest: F.regexp_replace(rest, "<(?=!--)", _NO_BODY))
        return F.when(t.contains("<!--"), changed).otherwise(t)

    return _bind(marked, marked_comments)


def _mark_unquotable(text: Column, rounds: int = 3) -> Column:
    """Openings of tags whose quotes lead to no end, marked.

    A quote swaps two of the states "outside", "in double quotes" and "in single quotes", so readings
    that start in different states never meet: at most three have no end. One round marks every
    opening that lies outside the quotes of one such reading.
    """
    if not rounds:
        return text

    def marked(t: Column) -> Column:
        def outside(rest: Column) -> Column:
            parts = F.regexp_extract_all(rest, F.lit(_QUOTED), F.lit(0))
            shown = F.transform(
                parts,
                lambda part: F.when(part.rlike("^[\"']"), part).otherwise(
                    F.translate(part, f"<{_NO_BODY}", f"{_NO_QUOTES}{_NEITHER}")
                ),
            )
            return F.array_join(shown, "")

        walked = F.char_length(F.regexp_extract(t, _WALK, 0))
        return _bind(
            walked,
            lambda k: F.when(k >= F.char_length(t), t).otherwise(
                _mark_unquotable(_after(t, k, outside), rounds - 1)
            ),
        )

    return _bind(text, marked)


def strip_markup(text: Column, drop_script: bool = False) -> Column:
    """Text nodes joined by a space, entities still encoded, script text kept by default.

    The time is in proportion to the text, whatever is left open in it.
    """

    def visible(lexeme: Column) -> Column:
        raw = F.lit("") if drop_script else F.replace(
            F.regexp_extract(lexeme, RAW_TEXT, 2), F.lit("&"), F.lit(_SHIELD)
        )
        return (
            F.when(lexeme.rlike(RAW_TEXT_OPEN), raw)
            .when(lexeme.rlike(MARKUP_OPEN), F.lit(""))
            .otherwise(lexeme)
        )

    def read(marked: Column) -> Column:
        lexemes = F.regexp_extract_all(marked, F.lit(HTML_LEXEME), F.lit(0))
        joined = F.array_join(F.transform(lexemes, visible), " ")
        return F.translate(joined, f"{_NO_QUOTES}{_NO_BODY}{_NEITHER}", "<<<")

    shown = _bind(_mark_unquotable(_mark_endless(text)), read)
    return F.when(text.contains("<"), shown).otherwise(text)


def clean_html(text: Column, drop_script: bool = False) -> Column:
    """Visible text of an HTML fragment, whitespace collapsed."""
    decoded = decode_entities(strip_markup(text, drop_script), text)
    return collapse_spaces(F.replace(decoded, F.lit(_SHIELD), F.lit("&")))


def slugify(text: Column) -> Column:
    """ASCII words in lower case joined by hyphens."""
    beyond_ascii = text.rlike(r"[^\x00-\x7f]")
    ascii_text = F.when(beyond_ascii, _ascii_fold(F.when(beyond_ascii, text))).otherwise(text)
    kept = F.regexp_replace(F.lower(ascii_text), r"[^a-z0-9_\x09-\x0d\x1c-\x20-]", "")
    hyphens = F.regexp_replace(kept, r"[\x09-\x0d\x1c-\x20_]+", "-")
    return F.regexp_replace(hyphens, r"^-+|-+\z", "")
