"""Translation of books as jobs over all books at once: sections, chunks, prompts, calls, replies, output.

A chunk's prompt needs what the chunks before have left in the memory, so a run goes
in waves: the next ``wave`` chunks of every book are one job, the memory of each book
is folded from the log of updates, and the log is what a run resumes from. A model is
a function of two columns, payload and prompt, that gives a column of replies, such as
a pandas UDF around a client.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions import prompts, reply
from folio.functions import text as T
from folio.operators import assemble, memory, mentions, pack, segment, state
from folio.session import kept, preset, whole

Call = Callable[[Column, Column], Column]


def offline(payload: Column, prompt: Column) -> Column:
    """A model that needs no network: the text as it is."""
    draft = F.regexp_extract(payload, r"(?s)<traduccion_existente>\n(.*)\n</traduccion_existente>", 1)
    text = F.when(draft != "", draft).otherwise(payload)
    return F.to_json(F.struct(text.alias("translation"), F.lit(0.9).alias("confidence"), F.lit("").alias("notes")))


def book_chunks(books: DataFrame, size: str = "standard") -> DataFrame:
    """books: (book_id, sections). Chunks numbered through each book."""
    least, most = preset(size)
    sections = books.select("book_id", F.posexplode("sections").alias("source_section", "text"))
    return pack.indexed(pack.chunks(segment.segments(sections, "book_id", "source_section"), least, most, "book_id", "source_section"), "book_id", "source_section")


def finished(done: DataFrame) -> DataFrame:
    """(book_id, text) of answered chunks."""
    return assemble.reassembled(done, "book_id", "book_index", "source_section", assemble.chosen_text(F.coalesce("translated", F.lit("")), F.col("status"), F.col("original")))


def summary(done: DataFrame, resumed: DataFrame | None = None) -> DataFrame:
    """Counts by status, and whether some chunk of the book was done before this run."""
    counts = state.counts(done, "book_id")
    if resumed is None:
        return counts.withColumn("resumed", F.lit(False))
    before = resumed.select("book_id").distinct().withColumn("_before", F.lit(True))
    return counts.join(before, "book_id", "left").withColumn("resumed", F.coalesce("_before", F.lit(False))).drop("_before")


def answered(chunks: DataFrame, memories: DataFrame, call: Call, task: str = "translate", source: str = "en", target: str = "es") -> DataFrame:
    """chunks (book_id, book_index, original and, to fix, source) with the answers of one wave.

    memories: (book_id, voice, decisions, glossary, characters, last_scene) before it; a book without one has the base
    memory. A reply that is null flags its chunk alone.
    """
    base = memory.of_json(F.lit(memory.BASE_JSON))
    rows = chunks.join(memories.select("book_id", F.struct("voice", "decisions", "glossary", "characters", "last_scene").alias("_m")), "book_id", "left")
    about = F.coalesce(F.col("source"), F.col("original")) if task == "fix" else F.col("original")
    rows = rows.withColumn("_m", F.coalesce("_m", base)).withColumn("_m", memory.compressed(F.col("_m"), about))
    prompt = prompts.prompt(task, source, target, *[F.col(f"_m.{c}") for c in ("voice", "decisions", "glossary", "characters", "last_scene")])
    payload = {"translate": lambda: F.col("original"), "fix": lambda: T.fix_payload(F.col("source"), F.col("original"), source, target), "polish": lambda: T.polish_payload(F.col("original"), target)}[task]()
    rows = rows.withColumns({"_prompt": prompt, "_payload": payload})
    rows = kept(rows.withColumn("_raw", call(F.col("_payload"), F.col("_prompt"))).drop("_m", "_payload"))  # a call is made once
    tokens = T.est_tokens(F.col("_raw")) + T.est_tokens(F.col("_prompt")) + T.est_tokens(F.col("original"))
    rows = rows.withColumn("_r", F.when(F.col("_raw").isNotNull(), T.bound(F.col("_raw"), reply.parsed)))
    return rows.withColumns({
        "translated": F.col("_r.translation"), "confidence": F.col("_r.confidence"), "notes": F.col("_r.notes"), "tokens": F.coalesce(tokens, F.lit(0)), "prompt_chars": F.length("_prompt"),
        "status": F.coalesce(T.status_of(F.col("_r.confidence")), F.lit("flagged")),
    }).drop("_r", "_raw", "_prompt")


def updates_of(done: DataFrame, memories: DataFrame, extracted: Column | None = None) -> DataFrame:
    """(book_id, book_index and the update that each answered chunk brings): what is told without a model, and an extraction reply's values before it."""
    text = F.concat_ws("\n", "original", "translated")
    found = mentions.character_mentions(done.withColumn("text", text), "book_id", "book_index").groupBy("book_id", "book_index").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_names"))
    rows = done.where("translated is not null").join(found, ["book_id", "book_index"], "left").join(memories.select("book_id", F.col("voice").alias("_so_far")), "book_id", "left")
    so_far = F.coalesce("_so_far", F.lit(L.DEFAULT_VOICE))
    named = F.map_from_entries(F.transform(F.coalesce("_names", F.array().cast("array<struct<rank:int,name:string>>")), lambda n: F.struct(n["name"], F.lit(L.GENERIC))))
    local = F.struct(
        memory.local_voice(T.voice(F.col("translated"), so_far), so_far).alias("voice"), F.create_map().cast("map<string,string>").alias("glossary"), named.alias("characters"),
        T.style_decisions(F.col("notes")).alias("decisions"), T.scene_digest(F.col("translated")).alias("last_scene"),
    )
    news = reply.update(extracted) if extracted is not None else None
    merged = local.withField("rejected", F.array().cast("array<string>")) if news is None else memory.merged_update(local, F.when(extracted.isNotNull(), news))
    return rows.select("book_id", "book_index", merged.alias("u")).select("book_id", "book_index", "u.*")


def run(chunks: DataFrame, call: Call, log: str, task: str = "translate", source: str = "en", target: str = "es", wave: int = 8) -> DataFrame:
    """Answers all pending chunks, wave by wave, and appends them to the log folder; returns the log's chunks.

    A run on the same log goes on where the one before ended: waves whose folder is whole are not made again.
    """
    spark = chunks.sparkSession
    last = chunks.agg(F.max("book_index")).first()[0]  # one number
    kept_updates = None
    for k in range(0 if last is None else last // wave + 1):
        part = chunks.where(F.floor(F.col("book_index") / wave) == k)
        memories = _latest(spark, kept_updates)
        if not whole(spark, f"{log}/chunks/wave={k}"):
            answered(part, memories, call, task, source, target).write.mode("overwrite").parquet(f"{log}/chunks/wave={k}")
        done = spark.read.parquet(f"{log}/chunks/wave={k}")
        if not whole(spark, f"{log}/updates/wave={k}"):
            updates_of(done, memories).write.mode("overwrite").parquet(f"{log}/updates/wave={k}")
        kept_updates = spark.read.parquet(f"{log}/updates")
    return spark.read.parquet(f"{log}/chunks").drop("wave") if last is not None else answered(chunks, _latest(spark, None), call, task, source, target)


def logged(spark, log: str) -> DataFrame | None:
    """The chunks that earlier runs have left in a log, None without any."""
    waves = 0
    while whole(spark, f"{log}/chunks/wave={waves}"):
        waves += 1
    return kept(spark.read.parquet(f"{log}/chunks").where(F.col("wave") < waves)) if waves else None


def _latest(spark, updates: DataFrame | None) -> DataFrame:
    if updates is None:
        return spark.createDataFrame([], "book_id long, voice string, decisions array<string>, glossary map<string,string>, characters map<string,string>, last_scene string")
    states = memory.fold(updates, "book_id", "book_index")
    return states.groupBy("book_id").agg(F.max_by(F.struct("voice", "decisions", "glossary", "characters", "last_scene"), "book_index").alias("m")).select("book_id", "m.*")
