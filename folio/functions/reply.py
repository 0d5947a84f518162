"""Parsing of semi-structured replies of text models, in degrading steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions.text import strip

_FENCED = r"(?s)```(?:json)?\s*(\{.*\})\s*```"
_BARE = r"(?s)\{.*\}"


def _section(names: str, body: str) -> str:
    return rf"(?imu)^#{{1,3}}\s*(?:{names})\s*\n+{body}"


_UP_TO_NEXT = r"([\s\S]+?)(?=\n#{1,3}\s|\z)"
_TRANSLATION, _NOTES = _section("Traducci[oó]n|Translation", _UP_TO_NEXT), _section("Notas?|Notes?", _UP_TO_NEXT)
_CONFIDENCE = _section("Confianza|Confidence", r"\s*([0-9.]+)")


def as_object(text: Column) -> Column:
    """A variant if the text is a JSON object with some key, else null."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT<") & (F.schema_of_variant(v) != "OBJECT<>"), v)


def json_object(text: Column) -> Column:
    """The reply itself, the object in a fence, or the first brace to the last."""
    t = strip(text)
    some = lambda pattern, group: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    return F.coalesce(as_object(t), as_object(some(_FENCED, 1)), as_object(some(_BARE, 0)))


def _text(v: Column, *names: str) -> Column:
    values = [F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names]
    return F.coalesce(*values)


def parsed(text: Column) -> Column:
    """struct(translation, confidence, notes) of any reply."""
    t = strip(text)
    v = json_object(text)
    given = F.try_variant_get(v, "$.confidence", "string")
    first = F.nullif(strip(F.coalesce(_text(v, "translation"), F.lit(""))), F.lit(""))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(given.try_cast("double"), F.lit(0.5))))
    of_json = F.struct(F.coalesce(first, strip(F.coalesce(_text(v, "text", "result"), F.lit("")))).alias("translation"), sure.alias("confidence"), strip(F.coalesce(_text(v, "notes", "note"), F.lit(L.NO_NOTES))).alias("notes"))
    headed = F.nullif(strip(F.regexp_extract(t, _TRANSLATION, 1)), F.lit(""))
    level = F.nullif(F.regexp_extract(t, _CONFIDENCE, 1), F.lit("")).try_cast("double")
    of_headings = F.struct(
        headed.alias("translation"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(level, F.lit(0.6)))).alias("confidence"),
        F.coalesce(F.nullif(strip(F.regexp_extract(t, _NOTES, 1)), F.lit("")), F.lit(L.NO_NOTES)).alias("notes"),
    )
    plain = F.regexp_replace(t, r"```[^\n]*\n?", "")
    plain = F.regexp_replace(plain, r"(?m)^#{1,6}\s+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\*{1,3}(.+?)\*{1,3}", "$1"), r"_{1,2}(.+?)_{1,2}", "$1")
    of_text = F.struct(strip(F.regexp_replace(plain, "\n{3,}", "\n\n")).alias("translation"), F.lit(0.3).alias("confidence"), F.lit("Respuesta no estructurada.").alias("notes"))
    return F.when(v.isNotNull(), of_json).when(headed.isNotNull(), of_headings).otherwise(of_text)


def update(text: Column) -> Column:
    """struct(voice, glossary, characters, decisions, last_scene, rejected) of an extraction reply; empty if it has no object."""
    v = json_object(text)
    word = lambda n: F.nullif(strip(F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit(""))), F.lit(""))
    table = lambda n: F.map_filter(F.coalesce(F.try_variant_get(v, f"$.{n}", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, x: (k != "") & (F.coalesce(x, F.lit("")) != ""))
    items = lambda n: F.filter(F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.struct(word("voice").alias("voice"), table("glossary").alias("glossary"), table("characters").alias("characters"), items("decisions").alias("decisions"), word("last_scene").alias("last_scene"), items("rejected").alias("rejected"))
