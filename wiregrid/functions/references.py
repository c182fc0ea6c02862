"""Character references of HTML as expressions: names from a table, numbers by rule."""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is taken for a reference.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACED = "�"
#: Names that also count without a semicolon, the longest first.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Names and what they stand for as one text, a literal that planning passes on as it is.
_AFTER_NAME, _AFTER_VALUE = "\x01", "\x02"
_NAMES = _AFTER_VALUE + "".join(
    f"{name}{_AFTER_NAME}{value}{_AFTER_VALUE}" for name, value in sorted(html5.items())
)
#: Numbers below this are looked up: some of them stand for another character or for none.
_LOOKED_UP = 160
_LOW = "".join(html.unescape(f"&#{n};") or _AFTER_NAME for n in range(_LOOKED_UP))


def _named(name: Column) -> Column:
    """The characters a name stands for, or null."""
    names = F.lit(_NAMES)
    key = F.concat(F.lit(_AFTER_VALUE), name, F.lit(_AFTER_NAME))
    value = F.substring(names, F.instr(names, key) + F.char_length(name) + 2, F.lit(8))
    known = name.rlike(r"^[A-Za-z0-9]+;?\z") & (F.instr(names, key) > 0)
    return F.when(known, F.substring_index(value, _AFTER_VALUE, 1))


def _by_name(name: Column) -> Column:
    """The characters of a name; of a longer text that begins with one, those and the rest."""
    begun = F.regexp_extract(name, "^(?:" + "|".join(_OPEN_NAMES) + ")", 0)
    rest = F.substring(name, F.char_length(begun) + 1, F.char_length(name))
    return F.coalesce(
        _named(name), F.concat(_named(begun), rest), F.concat(F.lit("&"), name)
    )


def _code(reference: Column) -> Column:
    """The number of a numeric reference; one beyond all characters if it has too many digits."""
    decimal = F.regexp_extract(reference, "^&#0*([0-9]+)", 1)
    sixteen = F.regexp_extract(reference, "^&#[xX]0*([0-9a-fA-F]+)", 1)
    digits = F.when(sixteen != "", sixteen).otherwise(decimal)
    number = F.when(sixteen != "", F.conv(sixteen, 16, 10)).otherwise(decimal)
    return F.when(F.char_length(digits) > 8, F.lit(0x110000)).otherwise(number.cast("long"))


def _by_number(code: Column) -> Column:
    low = F.translate(F.substring(F.lit(_LOW), code.cast("int") + 1, F.lit(1)), _AFTER_NAME, "")
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    beyond = ((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF)
    # The last two characters of every plane and a run of the first are no characters.
    none = ((code >= 0xFDD0) & (code <= 0xFDEF)) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    return (
        F.when(code < _LOOKED_UP, low)
        .when(beyond, F.lit(_REPLACED))
        .when(none, F.lit(""))
        .otherwise(wide)
    )


def decode_references(text: Column) -> Column:
    """Every reference of a text as the characters it stands for; unknown ones stay."""

    def decoded(reference: Column) -> Column:
        numeric = reference.rlike("^&#(?:[0-9]|[xX][0-9a-fA-F])")
        return F.when(numeric, _by_number(_code(reference))).otherwise(
            _by_name(F.substring(reference, 2, 40))
        )

    between = F.split(text, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), decoded)
    return F.array_join(
        F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
