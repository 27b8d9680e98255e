"""Text and attributes out of HTML, as column expressions.

Everything here is JVM side and row local: a page never leaves its task.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.binding import bind

# Whitespace as Python's str methods see it: Unicode spaces and the four separators.
_SPACE = r"[\s\x1c-\x1f]"
# The inside of a tag: attribute values in quotes may hold '>'.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TAG = rf"<[/!?]?[a-zA-Z]{_ATTRIBUTES}>"
# What may stand between two elements that count as neighbours.
GAP = r"(?:\s++|<!--.*?-->)*+"
_NON_TEXT = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
    r"|<template(?=[\s/>]).*?(?:</template\s*>|\z)"
    r"|<rt(?=[\s/>]).*?(?:</rt\s*>|\z)"
    r"|<rp(?=[\s/>]).*?(?:</rp\s*>|\z)"
    rf"|{_TAG}"
)

# Entities decoded by plain replacement, '&' last; a page with any other entity takes
# the general route.
_COMMON = {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "nbsp": " ", "amp": "&"}
_OTHER_ENTITY = rf"&(?!(?:{'|'.join(_COMMON)})(?![a-zA-Z0-9]))(?:[a-zA-Z]|#[0-9xX])"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}++|(?<!{_SPACE}){_SPACE}++\z", "")


def collapse(text: Column) -> Column:
    """Every run of whitespace becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def drop_markup(markup: Column, separator: str = " ") -> Column:
    """Replace tags, comments, scripts and styles, in document order, in one pass."""
    return F.regexp_replace(markup, _NON_TEXT, separator)


def _entity_table() -> Column:
    """Named entities from the standard table, the frequent Latin ones first."""
    names = {n: html.entities.html5[f"{n};"] for n in html.entities.name2codepoint}
    for name, text in html.entities.html5.items():
        names.setdefault(name.rstrip(";"), text)
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _windows_controls() -> Column:
    """Numeric references 128-159 mean the Windows-1252 characters."""
    table = {str(b): bytes([b]).decode("cp1252", errors="replace") for b in range(128, 160)}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _decode_every_entity(text: Column) -> Column:
    names, controls = _entity_table(), _windows_controls()

    def numeric(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^#([0-9]+)", 1)
        code = F.when(decimal != "", decimal.try_cast("long")).otherwise(
            F.conv(F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("long")
        )
        char = (
            F.when(code.between(128, 159), F.element_at(controls, code.cast("string")))
            .when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF),
                  F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
            .otherwise(F.lit("�"))
        )
        return F.concat(char, F.regexp_replace(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))

    def named(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([a-zA-Z][a-zA-Z0-9]*)", 1)
        char = F.element_at(names, name)
        return F.when(
            char.isNotNull(), F.concat(char, F.regexp_replace(piece, r"^[a-zA-Z0-9]+;?", ""))
        ).otherwise(F.concat(F.lit("&"), piece))

    def decoded(piece: Column) -> Column:
        return F.when(piece.rlike(r"^#(?:[0-9]|[xX][0-9a-fA-F])"), numeric(piece)).otherwise(named(piece))

    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))


def decode_entities(text: Column) -> Column:
    """Decode character references once; the semicolon may be missing."""

    def decode(plain: Column) -> Column:
        common = plain
        for name, char in _COMMON.items():
            common = F.regexp_replace(common, rf"&{name}(?:;|(?![a-zA-Z0-9]))", char)
        return (
            F.when(~F.contains(plain, F.lit("&")), plain)
            .when(~plain.rlike(_OTHER_ENTITY), common)
            .otherwise(_decode_every_entity(plain))
        )

    return bind(text, decode)


def html_to_text(markup: Column) -> Column:
    """Visible text: a space between text nodes, whitespace collapsed and trimmed."""
    return collapse(decode_entities(drop_markup(markup)))


def element_text(inner: Column) -> Column:
    """Text of one element: nothing between text nodes, ends trimmed."""
    return strip(decode_entities(drop_markup(inner, "")))


def class_contains(part: str) -> str:
    """Pattern of a class attribute holding `part` anywhere."""
    return rf"""class\s*=\s*(?:"[^"]*{part}[^"]*"|'[^']*{part}[^']*'|[^\s"'>]*{part})"""


def class_token(name: str) -> str:
    """Pattern of a class attribute holding the whole word `name`."""
    word = rf"(?<![\w-]){name}(?![\w-])"
    return rf"""class\s*=\s*(?:"[^"]*{word}[^"]*"|'[^']*{word}[^']*'|{word})"""


def open_tag(attribute: str, name: str = r"[a-zA-Z][a-zA-Z0-9]*") -> str:
    """Pattern of an opening tag; its name is group 1."""
    return rf"<({name})\s(?:[^>]*?\s)?{attribute}{_ATTRIBUTES}>"


def balanced(rest: Column, tag: Column) -> Column:
    """`rest` up to the close tag that matches a `tag` opened just before it.

    Mostly nothing of that name lies between, and the first close tag is the one.
    Otherwise the text is cut at every tag of that name and the depth is walked; an
    element that is never closed runs to the end.
    """
    close = F.concat(F.lit("</"), tag)

    def until(rest: Column, plain: Column) -> Column:
        low = F.lower(plain)
        after = F.substr(rest, F.length(plain) + F.length(close) + 1, F.lit(1))
        alone = ~F.contains(low, F.lower(close)) & ~F.contains(low, F.lower(F.concat(F.lit("<"), tag)))
        return F.when(alone & after.isin(">", " ", "\n"), plain).otherwise(_balanced_by_depth(rest, tag))

    def cut(rest: Column) -> Column:
        return bind(F.call_function("substring_index", rest, close, F.lit(1)), lambda plain: until(rest, plain))

    return bind(rest, cut)


def _balanced_by_depth(rest: Column, tag: Column) -> Column:
    cut_at = F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"[\s>/])"))
    start = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("taken"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(F.startswith(piece, F.lit("</")), -1).otherwise(1)
        return F.when(state["depth"] == 0, state).otherwise(
            F.struct(
                depth.alias("depth"),
                (state["taken"] + F.when(depth == 0, 0).otherwise(1)).alias("taken"),
            )
        )

    def cut(pieces: Column) -> Column:
        walked = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step)
        return F.array_join(F.slice(pieces, F.lit(1), walked["taken"]), "")

    return bind(F.split(rest, cut_at), cut)


def first_inner(markup: Column, attribute: str, name: str = r"[a-zA-Z][a-zA-Z0-9]*") -> Column:
    """Inner markup of the first element with this attribute; null when there is none."""
    opening = open_tag(attribute, name)

    def inside(found: Column) -> Column:
        tag = F.regexp_extract(found, r"\A<([a-zA-Z][a-zA-Z0-9]*)", 1)
        return F.when(found != "", balanced(F.regexp_replace(found, rf"\A{opening}", ""), tag))

    return bind(F.regexp_extract(markup, rf"(?s){opening}.*\z", 0), inside)


def first_element_text(markup: Column, attribute: str) -> Column:
    """Text of the first element with this attribute; null when there is none.

    Mostly it holds text alone, up to its close tag, which one pattern reads; elements within
    it, and whatever else may stand there, take the general way.
    """
    plain = rf"(?s){open_tag(attribute)}([^<]*+)(</\1\s*+>)?"

    def read(markup: Column) -> Column:
        closed = F.regexp_extract(markup, plain, 3) != ""
        text = strip(decode_entities(F.regexp_extract(markup, plain, 2)))
        return F.when(closed, text).otherwise(element_text(first_inner(markup, attribute)))

    return bind(markup, read)


def first_text(markup: Column, class_part: str) -> Column:
    """Text of the first element whose class contains `class_part`, else ''."""
    return F.coalesce(first_element_text(markup, class_contains(class_part)), F.lit(""))


def first_href(markup: Column, class_part: str) -> Column:
    """href of the first element whose class contains `class_part`, else ''."""
    tag = F.regexp_extract(markup, rf"(?s){open_tag(class_contains(class_part))}", 0)
    return tag_href(tag)


def tag_href(tag: Column) -> Column:
    """href of an opening tag, else ''."""
    value = F.regexp_extract(tag, r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    bare = F.regexp_replace(value, r"""\A["']|["']\z""", "")
    return F.coalesce(decode_entities(bare), F.lit(""))
