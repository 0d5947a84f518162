"""The memory as a stream: chunks come in by book, the state after each is given out; and intake that takes each content once."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from folio import lexicons as L
from folio.functions import reply
from folio.functions import text as T
from folio.operators import memory as M

OUTPUT = "book_id long, chunk_index int, extracted boolean, voice string, decisions array<string>, glossary map<string,string>, characters map<string,string>, last_scene string, version int"


def _list(x) -> list:
    return [] if x is None else list(x)


class _Table:
    """A map state that is read once for a key's rows; only entries that change are written."""

    def __init__(self, state):
        self.state = state
        self.rows = {k[0]: tuple(v) for k, v in state.iterator()}
        self.next = 1 + max((place for _, place in self.rows.values()), default=-1)

    def put(self, name, value) -> None:
        place = self.rows[name][1] if name in self.rows else self.next
        self.next = max(self.next, place + 1)
        self.rows[name] = (value, place)
        self.state.updateValue((name,), (value, place))

    def drop(self, name) -> None:
        if self.rows.pop(name, None) is not None:
            self.state.removeKey((name,))

    def told(self) -> list[tuple]:
        return [(k, v[0]) for k, v in sorted(self.rows.items(), key=lambda x: x[1][1])]


class MemoryProcessor(StatefulProcessor):
    """A book's memory in parts: terms and names as maps, decisions as a list, voice, scene, the count of quiet chunks and the version as values.

    An update counts at a chunk that speaks for itself (``loud``) or at each ``every``-th quiet one; one that can't
    be read changes nothing. Updates come cleaned: what depends on one value alone is done in columns before.
    """

    every = L.EXTRACT_EVERY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("values", "voice string, last_scene string, quiet int, version int")
        self.terms = handle.getMapState("terms", "term string", "value string, place int")
        self.names = handle.getMapState("names", "name string", "what string, place int")
        self.decided = handle.getListState("decisions", "text string, key string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A book's memory from before the stream."""
        m = initialState.to_dict("records")[0]
        self.values.update((m["voice"], m["last_scene"], 0, int(m["version"])))
        for state, entries in ((self.terms, m["glossary"]), (self.names, m["characters"])):
            for place, e in enumerate(_list(entries)):
                state.updateValue((e["k"],), (e["v"], place))
        if len(_list(m["decisions"])):
            self.decided.put([(d["k"], d["v"]) for d in _list(m["decisions"])])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        voice, scene, quiet, version = self.values.get() if self.values.exists() else (L.DEFAULT_VOICE, "", 0, 0)
        terms, names = _Table(self.terms), _Table(self.names)
        decided = [tuple(d) for d in self.decided.get()] if self.decided.exists() else []
        out = []
        for r in pd.concat(rows).sort_values("chunk_index").to_dict("records"):
            wanted = bool(r["loud"])
            quiet += not wanted
            taken = (wanted or quiet >= self.every) and bool(r["given"])
            if taken:
                quiet = 0
                voice, scene = r["voice"] or voice, r["last_scene"] or scene
                for name in _list(r["rejected"]):
                    names.drop(name)
                for e in _list(r["glossary"]):
                    if e["k"] not in terms.rows and len(terms.rows) < L.MOST_GLOSSARY:
                        terms.put(e["k"], e["v"])
                for e in _list(r["characters"]):
                    held = names.rows.get(e["k"])
                    if (held is None and len(names.rows) < L.MOST_CHARACTERS) or (held is not None and held[0] == L.GENERIC and (e["v"] or "").strip()):
                        names.put(e["k"], e["v"])
                for d in _list(r["decisions"]):
                    if d["k"] and d["v"] and not any(d["v"] == k or SequenceMatcher(None, d["v"], k).ratio() >= L.SIMILAR for _, k in decided):
                        decided.append((d["k"], d["v"]))
                decided = decided[-L.MOST_DECISIONS :]
            version += 1
            out.append((key[0], r["chunk_index"], taken, voice, [t for t, _ in decided], dict(terms.told()), dict(names.told()), scene, version))
        self.values.update((voice, scene, quiet, version))
        if decided:
            self.decided.put(decided)
        yield pd.DataFrame(out, columns=["book_id", "chunk_index", "extracted", "voice", "decisions", "glossary", "characters", "last_scene", "version"])

    def close(self) -> None:
        pass


_PAIRS = "array<struct<k:string,v:string>>"


def _decisions(texts):
    return F.transform(texts, lambda d: F.struct(T.cleaned_decision(d).alias("k"), T.decision_key(T.cleaned_decision(d)).alias("v")))


def cleaned(rows: DataFrame) -> DataFrame:
    """rows: book_id, chunk_index, notes, force, update (an extraction reply, or null), as the processor takes them."""
    u = reply.update(F.col("update"))
    return rows.select(
        "book_id", "chunk_index", ((F.col("chunk_index") == 0) | F.coalesce("force", F.lit(False)) | T.speaks_of_news(F.col("notes"))).alias("loud"), F.col("update").isNotNull().alias("given"),
        F.nullif(T.strip(F.coalesce(u["voice"], F.lit(""))), F.lit("")).alias("voice"), T.truncated(u["last_scene"], L.MOST_SCENE_CHARS).alias("last_scene"), u["rejected"].alias("rejected"),
        M._entries(u["glossary"]).cast(_PAIRS).alias("glossary"), F.filter(M._entries(u["characters"]), lambda e: T.valid_name(e["k"])).cast(_PAIRS).alias("characters"), _decisions(u["decisions"]).alias("decisions"),
    )


def memory_stream(updates: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """updates as ``cleaned`` takes them. memories: (book_id, memory as JSON, version), the state to begin with. Needs the RocksDB state store."""
    start = None
    if memories is not None:
        m = M.of_json(F.col("memory"))
        start = memories.where(m.isNotNull()).select(
            "book_id", F.col("version").cast("int").alias("version"), m["voice"].alias("voice"), m["last_scene"].alias("last_scene"), M._entries(m["glossary"]).alias("glossary"),
            M._entries(m["characters"]).alias("characters"), _decisions(m["decisions"]).alias("decisions"),
        ).groupBy("book_id")
    rows = cleaned(updates).groupBy("book_id")
    return rows.transformWithStateInPandas(statefulProcessor=MemoryProcessor(), outputStructType=OUTPUT, outputMode="append", timeMode="none", initialState=start)


def resume(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> None:
    """Takes what has come into a folder of Parquet files since the last run, once each, into the target."""
    new = spark.readStream.schema(schema).parquet(folder).withColumn("taken_at", F.current_timestamp())
    new.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def take_batch(rows: DataFrame, batch_id: int, target: str, content: str) -> None:
    """One micro-batch into the target: of equal contents the first row by name, and none that an earlier batch has.

    A batch writes a partition of its own over whatever an attempt before has left there, and looks only at batches
    before it; so a replay after a crash writes the same rows again, and nothing twice.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("content_hash", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256))
    first = hashed.groupBy("content_hash").agg(F.min_by(F.struct(*rows.columns), F.struct(*[F.col(c) for c in rows.columns if c != content])).alias("r")).select("content_hash", "r.*")
    try:
        there = spark.read.parquet(target).where(F.col("batch_id") < batch_id).select("content_hash")
        first = first.join(there, "content_hash", "left_anti")
    except AnalysisException:  # nothing has been written yet
        pass
    first.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def intake(new: DataFrame, target: str, checkpoint: str, content: str = "content", write=take_batch) -> None:
    """Takes all that a stream of files brings now, each content once, however often a file is copied, renamed or replayed."""
    new.writeStream.foreachBatch(lambda rows, batch_id: write(rows, batch_id, target, content)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
