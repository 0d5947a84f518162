"""The memory of a book: glossary, characters, decisions, voice and last scene.

Each part is told apart from the others: voice and scene are the last value given,
the glossary the first, a character's entries are intervals between writes and
rejections of its name, and decisions pass a bounded buffer of the last ones.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions import text as T
from folio.operators import similar

SCHEMA = "voice string, decisions array<string>, glossary map<string,string>, characters map<string,string>, last_scene string"


def relevant(table: Column, text: Column) -> Column:
    """Entries whose key occurs in the text, in any case, as a substring. The text is lowered once."""
    return F.transform(F.array(F.lower(text)), lambda low: F.map_filter(table, lambda k, v: F.contains(low, F.lower(k))))[0]


def relevant_terms(chunks: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term", most: int = 200_000) -> DataFrame:
    """chunks x terms where the term occurs in the text, in any case, as a substring.

    The distinct lowered terms go into an automaton that finds all of them in one
    pass over a text; beyond ``most`` of them several passes are made, each with the
    terms of some hashes, so the driver holds one block at a time. Found terms meet
    the terms' rows by an equality join: texts are neither copied nor shuffled for
    terms that they don't hold. Null texts hold none; the empty term is in every text.
    """
    lowered = terms.where(F.col(term_col).isNotNull()).withColumn("_term", F.lower(term_col))
    distinct = lowered.select("_term").distinct()
    blocks = -(-distinct.count() // most) or 1
    block = F.pmod(F.xxhash64("_term"), F.lit(blocks))
    rows = chunks.withColumn("_low", F.lower(F.col(text_col)))
    out = None
    for k in range(blocks):
        some = [r[0] for r in distinct.where(block == k).collect()]  # at most about ``most``
        hits = rows.withColumn("_term", F.explode(_finder(some)(F.col("_low")))).drop("_low")
        out = hits if out is None else out.unionAll(hits)
    return out.join(lowered, "_term").drop("_term")


def _finder(terms: list[str]):
    made: list = []  # once a task, not for every batch

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        from ahocorasick import Automaton

        always = [t for t in terms if t == ""]
        if not made:
            made.append(Automaton())
            for t in terms:
                if t:
                    made[0].add_word(t, t)
            if len(made[0]):
                made[0].make_automaton()
        automaton = made[0]
        of = lambda x: always + (list(dict.fromkeys(t for _, t in automaton.iter(x))) if len(automaton) else [])
        return pa.array([None if x is None else of(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return found


#: The memory as JSON.
JSON = "struct<voice:string,decisions:array<string>,glossary:map<string,string>,characters:map<string,string>,last_scene:string>"
BASE_JSON = json.dumps({"voice": L.DEFAULT_VOICE, "decisions": [], "glossary": {}, "characters": {}, "last_scene": ""}, ensure_ascii=False)


def to_json(memory: Column) -> Column:
    return F.to_json(memory)


def of_json(raw: Column) -> Column:
    """The memory, or null where it can't be read; missing parts are those of the base memory."""
    m = F.from_json(raw, JSON, {"mode": "PERMISSIVE"})
    full = F.struct(
        F.coalesce(m["voice"], F.lit(L.DEFAULT_VOICE)).alias("voice"), F.coalesce(m["decisions"], F.array().cast("array<string>")).alias("decisions"),
        *[F.coalesce(m[c], F.create_map().cast("map<string,string>")).alias(c) for c in ("glossary", "characters")], F.coalesce(m["last_scene"], F.lit("")).alias("last_scene"),
    )
    return F.when(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT<"), full)


def based(versions: DataFrame, books: DataFrame, book: str = "book_id") -> DataFrame:
    """versions: (book, memory as JSON, version). Adds the base memory as the next version of each book without one, or whose latest can't be read."""
    latest = versions.groupBy(book).agg(F.max_by("memory", "version").alias("memory"), F.max("version").alias("version"))
    good = latest.where(of_json(F.col("memory")).isNotNull()).select(book)
    bare = books.select(book).distinct().join(good, book, "left_anti").join(latest.select(book, "version"), book, "left")
    seeds = bare.select(book, F.lit(BASE_JSON).alias("memory"), (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"))
    return versions.select(book, "memory", F.col("version").cast("int").alias("version")).unionByName(seeds)


def unenriched(candidates: DataFrame, characters: DataFrame, *keys: str) -> DataFrame:
    """(keys, force): whether some candidate (keys, name) is not in the memory (keys, name, what), or only with the general description."""
    rows = candidates.join(characters.select(*keys, "name", "what"), [*keys, "name"], "left")
    return rows.groupBy(*keys).agg(F.bool_or(F.col("what").isNull() | (F.col("what") == L.GENERIC)).alias("force"))


def local_voice(heard: Column, so_far: Column) -> Column:
    """The voice that a local update sets: the inferred one, while there is none or the general one."""
    return F.when((F.coalesce(so_far, F.lit("")) == "") | (so_far == L.DEFAULT_VOICE), heard)


def recent(decisions: Column, n: int = L.PROMPT_DECISIONS) -> Column:
    return F.when(F.size(decisions) > n, F.slice(decisions, -n, n)).otherwise(decisions)


def compressed(memory: Column, text: Column) -> Column:
    """What a prompt for this text needs of a memory struct."""
    return F.struct(
        memory["voice"].alias("voice"), recent(memory["decisions"]).alias("decisions"), relevant(memory["glossary"], text).alias("glossary"),
        relevant(memory["characters"], text).alias("characters"), T.truncated(memory["last_scene"], L.PROMPT_SCENE_CHARS).alias("last_scene"),
    )


def ratio(kept: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(kept / total)


def is_empty(memory: Column) -> Column:
    return (F.size(memory["glossary"]) == 0) & (F.size(memory["characters"]) == 0) & (F.size(memory["decisions"]) == 0)


def first_written(entries: DataFrame, book: str, order: list[str], key: str = "term", value: str = "value", most: int = L.MOST_GLOSSARY, with_first: bool = False) -> DataFrame:
    """Glossary: the first value of each key stays; keys beyond ``most`` are not taken."""
    at = F.struct(*order)
    firsts = entries.groupBy(book, key).agg(F.min_by(value, at).alias(value), F.min(at).alias("first"))
    place = F.row_number().over(W.partitionBy(book).orderBy("first", key))
    return firsts.withColumn("place", place).where(F.col("place") <= most).select(book, key, value, "place", *(["first"] if with_first else []))


def last_so_far(df: DataFrame, book: str, order: str, value: Column, name: str) -> DataFrame:
    """The latest value that is not blank, up to and with each row."""
    given = F.nullif(T.strip(value), F.lit(""))
    return df.withColumn(name, F.last(given, ignorenulls=True).over(W.partitionBy(book).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def merged_update(local: Column, extracted: Column) -> Column:
    """The model's values before the local ones; its rejected names go; decisions of both, without repeats."""
    characters = F.map_filter(F.map_concat(F.map_filter(local["characters"], lambda k, v: ~F.map_contains_key(extracted["characters"], k)), extracted["characters"]), lambda k, v: ~F.array_contains(extracted["rejected"], k))
    glossary = F.map_concat(F.map_filter(local["glossary"], lambda k, v: ~F.map_contains_key(extracted["glossary"], k)), extracted["glossary"])
    decisions = F.array_distinct(F.filter(F.concat(local["decisions"], extracted["decisions"]), lambda d: d != ""))
    both = F.struct(
        F.coalesce(F.nullif(extracted["voice"], F.lit("")), local["voice"]).alias("voice"), glossary.alias("glossary"), characters.alias("characters"),
        decisions.alias("decisions"), F.coalesce(F.nullif(extracted["last_scene"], F.lit("")), local["last_scene"]).alias("last_scene"), extracted["rejected"].alias("rejected"),
    )
    return F.when(extracted.isNull(), F.struct(*[local[c].alias(c) for c in ("voice", "glossary", "characters", "decisions", "last_scene")], F.array().cast("array<string>").alias("rejected"))).otherwise(both)


_ENTRY = "struct<k:string,v:string>"


def _entries(table: Column) -> Column:
    """A table's entries in their order; none of a null one."""
    return F.coalesce(F.transform(F.map_entries(table), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), F.array().cast(f"array<{_ENTRY}>"))


def _told(rows: Column, begin: Column, step, size: int = 256) -> Column:
    """What a state (a struct whose field ``out`` is an array) gives out over an array in order. Its ``out`` begins anew with each ``size`` rows, so that adding to it copies no more than these."""
    slices = T.bound(rows, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda k: F.slice(all_, k * size + 1, F.lit(size))))
    more = lambda s, part: T.bound(F.aggregate(part, s["state"], step), lambda t: F.struct(t.withField("out", begin["out"]).alias("state"), F.concat(s["outs"], F.array(t["out"])).alias("outs")))
    none = F.slice(F.array(begin["out"]), 1, 0)
    return F.aggregate(slices, F.struct(begin.alias("state"), none.alias("outs")), more, lambda s: F.flatten(s["outs"]))


def accepted_decisions(updates: DataFrame, book: str, order: str) -> DataFrame:
    """(book, order, text, place): the decisions that are new, numbered from 1 within their book.

    A decision is new if it is not like one of the last 18 before its chunk nor one accepted in its chunk. A book's
    decisions are gone through in order, in one aggregate whose buffer is bounded; only their keys are held. Books go
    to a fixed number of tasks, as few bytes are much work.
    """
    said = updates.select(book, order, F.posexplode(F.transform(F.coalesce("decisions", F.array().cast("array<string>")), T.cleaned_decision)).alias("_said_pos", "_text"))
    said = said.withColumn("_key", T.decision_key(F.col("_text"))).where("_text <> '' and _key <> ''")
    kind = updates.schema[order].dataType.simpleString()
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_said_pos").alias("pos"), F.col("_key").alias("key"))))
    begin = F.struct(F.lit(None).cast(kind).alias("at"), F.array().cast("array<string>").alias("last"), F.array().cast(f"array<struct<at:{kind},pos:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        held = F.when(s["at"].eqNullSafe(x["at"]), s["last"]).otherwise(recent(s["last"], L.MOST_DECISIONS))
        return T.bound(held, lambda last: F.when(F.array_contains(last, x["key"]) | F.exists(last, lambda k: similar.alike(x["key"], k)), F.struct(x["at"].alias("at"), last.alias("last"), s["out"].alias("out"))).otherwise(
            F.struct(x["at"].alias("at"), F.concat(last, F.array(x["key"])).alias("last"), F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), x["pos"].alias("pos")))).alias("out"))))

    tasks = int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    new = said.select(book, order, "_said_pos", "_key").repartition(tasks, book).groupBy(book).agg(_told(in_order, begin, step).alias("out"))
    new = new.select(F.col(book).alias("_book"), F.posexplode("out").alias("_n", "o")).select("_book", F.col("o.at").alias("_at"), F.col("o.pos").alias("_pos"), (F.col("_n") + 1).alias("_place"))
    on = F.col(book).eqNullSafe(F.col("_book")) & (F.col(order) == F.col("_at")) & (F.col("_said_pos") == F.col("_pos"))
    return said.join(new, on).select(book, order, F.col("_text").alias("text"), F.col("_place").alias("place"))


def character_changes(updates: DataFrame, book: str, order: str, most: int = L.MOST_CHARACTERS) -> DataFrame:
    """(book, name, what, since, until, pos): what the memory says of a name from the chunk ``since`` to before the chunk ``until`` (null: to the end).

    A name's rejections cut its life into islands. In an island the first write counts, and if it is the general
    description, the first rich one after it. That is all for books that never hold more than ``most`` names at once;
    in others a write may find the memory full, so their events are gone through in order, with the names held.
    """
    writes = updates.select(book, order, F.posexplode(F.filter(_entries(F.col("characters")), lambda e: T.valid_name(e["k"]))).alias("pos", "e"))
    writes = writes.select(book, order, F.lit(1).alias("kind"), "pos", F.col("e.k").alias("name"), F.col("e.v").alias("what"))
    gone = updates.select(book, order, F.explode(F.coalesce("rejected", F.array().cast("array<string>"))).alias("name")).distinct()
    events = writes.unionByName(gone.select(book, order, F.lit(0).alias("kind"), F.lit(-1).alias("pos"), "name", F.lit(None).cast("string").alias("what")))

    by_name = W.partitionBy(book, "name").orderBy(order, "kind", "pos").rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumn("island", F.sum(1 - F.col("kind")).over(by_name))
    rich = (F.trim(F.coalesce("what", F.lit(""))) != "") & (F.col("what") != L.GENERIC)
    at = F.struct(F.col(order).alias("at"), F.col("pos").alias("pos"), F.col("what").alias("what"))
    islands = events.groupBy(book, "name", "island").agg(
        F.min(F.when(F.col("kind") == 1, at)).alias("first"), F.min(F.when((F.col("kind") == 1) & rich, at)).alias("rich"), F.min(F.when(F.col("kind") == 0, F.col(order))).alias("cut")
    )
    until = F.lead("cut").over(W.partitionBy(book, "name").orderBy("island"))
    islands = islands.withColumn("until", until).where("first is not null")
    part = lambda x, end: F.struct(x["what"].alias("what"), x["at"].alias("since"), end.alias("until"), x["pos"].alias("pos"))
    first, better = F.col("first"), F.col("rich")
    upgraded = (first["what"] == L.GENERIC) & better.isNotNull()
    free = islands.select(book, "name", F.explode(F.when(upgraded, F.array(part(first, better["at"]), part(better, F.col("until")))).otherwise(F.array(part(first, F.col("until"))))).alias("p"))
    free = free.select(book, "name", "p.*")

    # how many names a book would hold: one more at each island's begin, one less at its end, removals of a chunk first
    moves = islands.select(book, F.col("first.at").alias("at"), F.lit(1).alias("kind"), F.col("first.pos").alias("pos"), F.lit(1).alias("d"))
    moves = moves.unionByName(islands.where("until is not null").select(book, F.col("until").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("pos"), F.lit(-1).alias("d")))
    held = F.sum("d").over(W.partitionBy(book).orderBy("at", "kind", "pos").rowsBetween(W.unboundedPreceding, 0))
    full = moves.groupBy(book).agg(F.sum("d").alias("net"), F.count_if(F.col("d") == 1).alias("begun")).where(F.col("begun") > most).select(book)
    crowded = moves.join(full, book, "left_semi").withColumn("held", held).where(F.col("held") > most).select(book).distinct()
    return free.join(crowded, book, "left_anti").unionByName(_crowded(events.join(crowded, book, "left_semi"), book, order, most))


def _crowded(events: DataFrame, book: str, order: str, most: int) -> DataFrame:
    """The same for books that fill the memory: an aggregate over a book's events that holds at most ``most`` names and gives out what changes."""
    kind = events.schema[order].dataType.simpleString()
    change = f"struct<name:string,what:string,since:{kind},pos:int,stays:boolean>"
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "kind", "pos", "name", "what")))
    begin = F.struct(F.create_map().cast("map<string,string>").alias("held"), F.array().cast(f"array<{change}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        known = F.map_contains_key(s["held"], x["name"])
        without = F.map_filter(s["held"], lambda k, v: k != x["name"])
        told = lambda stays: F.concat(s["out"], F.array(F.struct(x["name"].alias("name"), x["what"].alias("what"), x["at"].alias("since"), x["pos"].alias("pos"), F.lit(stays).alias("stays"))))
        state = lambda held, out: F.struct(held.alias("held"), out.alias("out"))
        better = (s["held"][x["name"]] == L.GENERIC) & (F.trim(F.coalesce(x["what"], F.lit(""))) != "") & (x["what"] != L.GENERIC)
        enters = (x["kind"] == 1) & ((~known & (F.size(s["held"]) < most)) | (known & F.coalesce(better, F.lit(False))))
        return F.when((x["kind"] == 0) & known, state(without, told(False))).when(enters, state(F.map_concat(without, F.create_map(x["name"], x["what"])), told(True))).otherwise(s)

    out = events.groupBy(book).agg(_told(in_order, begin, step).alias("o")).select(book, F.posexplode("o").alias("i", "o")).select(book, "i", "o.*")
    until = F.lead("since").over(W.partitionBy(book, "name").orderBy("i"))
    return out.withColumn("until", until).where("stays").select(book, "name", "what", "since", "until", "pos")


def _alive(rows: DataFrame, changes: DataFrame, book: str, order: str, name: str, size: int = 64) -> DataFrame:
    """rows with the table of what holds at each: intervals are dealt to the slices of ``size`` chunks that they reach into, so a slice holds the bounded memory and what changes within it."""
    slot = lambda c: F.floor(c / size).cast("long")
    ends = rows.groupBy(book).agg(F.max(order).alias("end"))
    reach = changes.join(ends, book).where((F.col("since") <= F.col("end")) & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    reach = reach.withColumn("slice", F.explode(F.sequence(slot(F.col("since")), slot(F.coalesce(F.col("until") - 1, F.col("end"))))))
    held = reach.groupBy(book, "slice").agg(F.array_sort(F.collect_list(F.struct("since", "pos", "name", "what", "until"))).alias("held"))
    out = rows.withColumn("slice", slot(F.col(order))).join(held, [book, "slice"], "left").drop("slice")
    now = F.filter("held", lambda h: (h["since"] <= F.col(order)) & (h["until"].isNull() | (h["until"] > F.col(order))))
    table = F.map_from_entries(F.transform(now, lambda h: F.struct(h["name"], h["what"])))
    return out.withColumn(name, F.coalesce(table, F.create_map().cast("map<string,string>"))).drop("held")


def fold(updates: DataFrame, book: str, order: str) -> DataFrame:
    """updates: one row per chunk with voice, glossary, characters, decisions, last_scene, rejected; the order is a chunk's whole number, one row each.

    Returns (book, order, the memory after it). Null books are left out: a memory belongs to a book.
    """
    updates = updates.where(F.col(book).isNotNull())
    rows = updates.select(book, order, "voice", F.when(F.coalesce("last_scene", F.lit("")) != "", T.truncated(F.col("last_scene"), L.MOST_SCENE_CHARS)).alias("last_scene"))
    so_far = W.partitionBy(book).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({
        "voice": F.coalesce(F.last(F.nullif(T.strip(F.col("voice")), F.lit("")), ignorenulls=True).over(so_far), F.lit(L.DEFAULT_VOICE)),
        "last_scene": F.coalesce(F.last("last_scene", ignorenulls=True).over(so_far), F.lit("")),
    })
    terms = updates.select(book, order, F.posexplode(_entries(F.col("glossary"))).alias("pos", "e")).select(book, order, "pos", F.col("e.k").alias("term"), F.col("e.v").alias("value"))
    terms = first_written(terms, book, [order, "pos"], with_first=True).select(book, "term", "value", "place", F.col(f"first.{order}").alias("since"))
    glossary = terms.select(book, F.col("term").alias("name"), F.col("value").alias("what"), "since", F.lit(None).cast(updates.schema[order].dataType).alias("until"), F.col("place").alias("pos"))
    rows = _alive(_alive(rows, glossary, book, order, "glossary"), character_changes(updates, book, order), book, order, "characters")

    # the last 18 accepted decisions after each chunk that brings one, then the latest such list
    new = accepted_decisions(updates, book, order)
    last = F.collect_list("text").over(W.partitionBy(book).orderBy("place").rowsBetween(1 - L.MOST_DECISIONS, 0))
    lists = new.withColumn("last", last).groupBy(book, order).agg(F.max_by("last", "place").alias("decisions"))
    rows = rows.join(lists, [book, order], "left")
    rows = rows.withColumn("decisions", F.coalesce(F.last("decisions", ignorenulls=True).over(so_far), F.array().cast("array<string>")))
    return rows.select(book, order, "voice", "decisions", "glossary", "characters", "last_scene")
