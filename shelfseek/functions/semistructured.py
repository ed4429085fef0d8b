"""Columns that hold printed dictionaries, printed arrays or JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfseek.functions.arrays import let
from shelfseek.functions.text import JAVASCRIPT_SPACE_CLASS, clean_display_text, strip_js

_RESPONSE = (
    "struct<candidates:array<struct<"
    "content:struct<parts:array<struct<text:string>>>,"
    "groundingMetadata:struct<groundingAttributions:array<struct<web:struct<uri:string,title:string>>>>>>>"
)


def _json(c: Column) -> Column:
    """One JSON document as a variant under ``$.doc``; null where anything else is in the text."""
    return F.try_parse_json(F.concat(F.lit('{"doc":'), c, F.lit("}")))


def first_image(c: Column) -> Column:
    """The first usable link among the large, high-resolution and thumbnail lists."""
    # The signs of a printed array, and the sizes in the order in which they are tried.
    text = F.replace(c, F.lit("'"), F.lit('"'))
    text = F.replace(text, F.lit("array(["), F.lit("["))
    text = F.regexp_replace(text, r"\],[\t-\r\x{FEFF}\p{Z}]*dtype=object\)", "]")
    def first(images: Column) -> Column:
        return F.coalesce(
            *[
                F.nullif(F.try_variant_get(images, f"$.doc.{size}[0]", "string"), F.lit(""))
                for size in ("large", "hi_res", "thumb")
            ]
        )

    return let(_json(text), first)


def details_map(c: Column) -> Column:
    """A printed dictionary as a map; null where it cannot be read as one.

    ``True``, ``False`` and ``None`` are replaced wherever they occur, also inside a value.
    """
    # How a printed dictionary differs from JSON.
    text = c
    for printed, json in (("'", '"'), ("True", "true"), ("False", "false"), ("None", "null")):
        text = F.replace(text, F.lit(printed), F.lit(json))
    return F.try_variant_get(_json(text), "$.doc", "map<string,string>")


def details_fallback(c: Column) -> Column:
    """What to show when the details cannot be read as a map."""
    return strip_js(
        F.regexp_replace(clean_display_text(c), f"[{{}}]|{JAVASCRIPT_SPACE_CLASS}+", " ")
    )


def json_or_empty(c: Column) -> Column:
    """JSON text of a complex column, ``{}`` where it is null."""
    return F.coalesce(F.to_json(c), F.lit("{}"))


def response_text(c: Column) -> Column:
    """The generated text of a model response, '' where there is none."""
    candidate = F.get(F.from_json(c, _RESPONSE)["candidates"], F.lit(0))
    return F.coalesce(F.get(candidate["content"]["parts"], F.lit(0))["text"], F.lit(""))


def response_sources(c: Column) -> Column:
    """The cited pages of a model response that have both a link and a title."""
    candidate = F.get(F.from_json(c, _RESPONSE)["candidates"], F.lit(0))
    pages = F.transform(candidate["groundingMetadata"]["groundingAttributions"], lambda a: a["web"])
    cited = F.filter(
        pages, lambda w: (F.coalesce(w["uri"], F.lit("")) != "") & (F.coalesce(w["title"], F.lit("")) != "")
    )
    return F.coalesce(cited, F.array().cast("array<struct<uri:string,title:string>>"))
