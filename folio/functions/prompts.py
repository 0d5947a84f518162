"""Instructions for the text model, rendered from a memory. The texts are our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio import lexicons as L

_TASKS = {
    "translate": "Translate the passage from {source} to {target}.",
    "fix": "Correct the {target} draft against the {source} original.",
    "polish": "Improve the style of the {target} draft; keep its meaning.",
}


_ANSWER = 'Answer with a JSON object: {"translation": text, "confidence": 0 to 1, "notes": text}.'


def listed(items: Column, empty: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(empty))


def pairs(table: Column, empty: str) -> Column:
    rows = F.transform(F.array_sort(F.map_entries(table)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.when(F.size(table) > 0, F.array_join(rows, "\n")).otherwise(F.lit(empty))


def prompt(task: str, source: str, target: str, voice: Column, decisions: Column, glossary: Column, characters: Column, last_scene: Column) -> Column:
    full = lambda c, empty: F.coalesce(F.nullif(c, F.lit("")), F.lit(empty))
    return F.concat_ws(
        "\n\n",
        F.lit(_TASKS[task].format(source=source, target=target)),
        F.concat(F.lit("Voice: "), full(voice, "not settled yet")),
        F.concat(F.lit("Decisions:\n"), listed(decisions, "none")),
        F.concat(F.lit("Glossary:\n"), pairs(glossary, "none")),
        F.concat(F.lit("Characters:\n"), pairs(characters, "none")),
        F.concat(F.lit("Last scene: "), full(last_scene, "this is the beginning")),
        F.lit(_ANSWER),
    )


def extraction(original: Column, translation: Column, notes: Column, names: Column) -> Column:
    """The request for an update of the memory."""
    ask = 'Answer with a JSON object: {"voice": text, "glossary": {term: value}, "characters": {name: description}, "decisions": [text], "last_scene": text, "rejected": [name]}.'
    return F.concat_ws(
        "\n\n", F.concat(F.lit("Original:\n"), original), F.concat(F.lit("Translation:\n"), translation), F.concat(F.lit("Notes: "), F.coalesce(F.nullif(notes, F.lit("")), F.lit(L.NO_NOTES))),
        F.nullif(candidates(names), F.lit("")), F.lit(ask),
    )


def candidates(names: Column) -> Column:
    """The section that lists candidates, empty without any."""
    return F.when(F.size(names) > 0, F.concat(F.lit("Candidates to confirm or reject:\n"), listed(names, ""))).otherwise(F.lit(""))
