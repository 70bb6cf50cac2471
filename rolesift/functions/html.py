"""HTML to text with built-in functions only: no Python worker is started."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities nearly all pages use, each decoded by one plain replace. `&amp;` is
# last, so that the chain decodes once and not twice.
_COMMON = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&amp;", "&"),
)
_UNCOMMON = r"&(?!(?:lt|gt|quot|#39|nbsp|middot|copy|amp);)[#A-Za-z]"

_NAMES = json.dumps(html.entities.html5)
_BARE = "|".join(
    sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
)

# A tag ends at its `>` outside quoted attribute values, or with the text
_INSIDE = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+(?:>|\z)"""

# Elements whose text is never shown end at their closing tag, or with the text
_SILENT = (
    rf"(?s)<(?:((?i:script|style|template))\b{_INSIDE}.*?(?:</(?i:\1)\s*>|\z)"
    rf"|(?i:rt|rp)\b{_INSIDE}.*?(?:</(?i:rt|rp|ruby)\s*>|\z)"
    r"|!--.*?(?:-->|\z))"
)
# Possessive, so that a long run of tags is matched without recursion
_TAGS = rf"(?:<(?:/?[a-zA-Z]|[!?]){_INSIDE})++"

# Every character that counts as white space, not only the ASCII ones
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _character(number: Column) -> Column:
    """The character of a code point; invalid ones become the replacement character."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    code = F.when(valid, number).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _decode_all(text: Column) -> Column:
    """One decoding pass over every named and numeric entity."""
    names = F.from_json(F.lit(_NAMES), "map<string,string>")
    chunks = F.split(text, "&")

    def decoded(chunk: Column) -> Column:
        full = F.regexp_extract(chunk, "^([a-zA-Z0-9]+;)", 1)
        bare = F.regexp_extract(chunk, f"^({_BARE})", 1)
        decimal = F.regexp_extract(chunk, "^#([0-9]+);?", 1)
        hexadecimal = F.regexp_extract(chunk, "^#[xX]([0-9a-fA-F]+);?", 1)
        number = F.coalesce(
            F.when(decimal != "", F.coalesce(decimal.try_cast("bigint"), F.lit(0))),
            F.when(hexadecimal != "", F.coalesce(
                F.conv(F.when(F.length(hexadecimal) <= 15, hexadecimal), 16, 10).cast("bigint"),
                F.lit(0))),
        )

        def rest(name: Column) -> Column:
            return F.substring(chunk, F.length(name) + 1, F.length(chunk))

        return F.coalesce(
            F.when(full != "", F.concat(F.try_element_at(names, full), rest(full))),
            F.when(bare != "", F.concat(F.try_element_at(names, bare), rest(bare))),
            F.when(
                number.isNotNull(),
                F.concat(
                    _character(number),
                    F.regexp_replace(chunk, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", ""),
                ),
            ),
            F.concat(F.lit("&"), chunk),
        )

    tail = F.transform(F.slice(chunks, F.lit(2), F.size(chunks)), decoded)
    return F.concat(F.get(chunks, F.lit(0)), F.array_join(tail, ""))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(text: Column) -> Column:
    """Decode entities once. Texts with none, or only common ones, take a short path."""

    def decoded(t: Column) -> Column:
        common = t
        for entity, char in _COMMON:
            common = F.replace(common, F.lit(entity), F.lit(char))
        return (
            F.when(~t.contains("&"), t)
            .when(t.rlike(_UNCOMMON), _decode_all(t))
            .otherwise(common)
        )

    return _once(text, decoded)


def _drop_markup(markup: Column, sep: str) -> Column:
    # A silent block leaves a tag behind, so that it parts two text nodes as one tag run
    without_silent = F.regexp_replace(markup, _SILENT, "<i>")
    return unescape(F.regexp_replace(without_silent, _TAGS, sep))


def html_text(markup: Column, sep: str = "\n") -> Column:
    """Text nodes joined by `sep`, entities decoded, outer white space trimmed."""
    return trim_space(_drop_markup(F.coalesce(markup, F.lit("")), sep))


def strip_html(markup: Column) -> Column:
    """One line of lower-case plain text. Escaped markup is decoded first."""
    plain = _drop_markup(unescape(F.coalesce(markup, F.lit(""))), " ")
    return F.lower(F.trim(F.regexp_replace(plain, f"{SPACE}+", " ")))
