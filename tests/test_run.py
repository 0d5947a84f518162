"""The memory as windows, similarity, scans, streams, exactly-once intake, runs in waves and the command line."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.cli import main
from folio.functions import prompts, reply
from folio.functions import text as T
from folio.operators import assemble, mentions, routing, scan, segment, similar
from folio.operators import memory as M
from folio.plans import pipeline
from folio.session import kept
from folio.streaming import memory as S

UPDATE = "book int, n int, voice string, glossary map<string,string>, characters map<string,string>, decisions array<string>, last_scene string, rejected array<string>"


def changed(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 3)):
        k = rng.randint(0, max(0, len(out) - 1))
        out[k : k + rng.randint(0, 1)] = rng.choice(["a", "é", " ", "", "xy"])
    return "".join(out)


def test_similarity_is_that_of_blocks(spark):
    rng = random.Random(4)
    short = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 22))) for _ in range(120)]
    long = ["".join(rng.choice("abc ") + rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(96, 110))) for _ in range(12)]
    pairs = [(x, changed(rng, x)) for x in short + long] + [("", ""), ("", "a"), ("ab", "ba"), ("a" * 210, "a" * 205), ("same", "same")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similar.ratio(F.col("a"), F.col("b")).alias("r"), similar.alike(F.col("a"), F.col("b")).alias("k")).collect()
    for r in got:
        score = SequenceMatcher(None, r.a, r.b).ratio()
        assert abs(r.r - score) < 1e-12 and r.k == (r.a == r.b or score >= L.SIMILAR), (r.a, r.b)


def test_similar_pairs_and_one_to_one(spark):
    rng = random.Random(5)
    gold = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    pred = [changed(rng, x) for x in gold[:40]]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = {(r.a, r.b): r.score for r in similar.similar_pairs(frame(pred, "a"), frame(gold, "b")).collect()}
    exp = {(a, b): SequenceMatcher(None, a, b).ratio() for a in pred for b in gold if a and b}
    assert got == pytest.approx({k: v for k, v in exp.items() if v >= L.SIMILAR})

    def greedy(golds, preds):
        left, hits = sorted(set(golds)), 0
        for p in sorted(set(preds)):
            score, best = max(((SequenceMatcher(None, p.lower(), g.lower()).ratio(), g) for g in left), key=lambda x: x[0], default=(0.0, None))
            if best is not None and score >= L.SIMILAR:
                hits += 1
                left.remove(best)
        return hits

    sets = [(k, rng.sample(gold, 25), rng.sample(pred, 25)) for k in range(4)] + [(9, [], ["a"]), (10, [""], ["", "A"]), (11, None, None)]
    out = {r.k: r.tp for r in assemble.fuzzy_hits(spark.createDataFrame(sets, "k int, gold array<string>, pred array<string>"), "k").collect()}
    assert out == {k: greedy(g or [], p or []) for k, g, p in sets}


def test_similar_pairs_of_short_and_long_texts(spark):
    """Pairs on both sides of the length from which letters are joined, and few proposals where all words have the same letters."""
    rng = random.Random(8)
    words = list({"".join(rng.choice("abc") for _ in range(rng.choice([7, 8, 11, 12, 13, 14, 16]))) for _ in range(90)})
    other = list({changed(rng, x) for x in words} - {""})
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    exp = {(a, b) for a in words for b in other if SequenceMatcher(None, a, b).ratio() >= L.SIMILAR}
    assert {(r.a, r.b) for r in similar.similar_pairs(frame(words, "a"), frame(other, "b")).collect()} == exp
    mixed = list({"".join(rng.sample("abcdefghij", 10)) for _ in range(60)})
    short, pairs = similar._common(frame(mixed, "a"), frame(mixed, "b"), L.SIMILAR)
    assert short == 12 and pairs.distinct().count() < 2 * len(mixed)  # letters alone would propose all 3,600
    sets = [(None, ["Marta"], ["Martas"]), (1, ["Marta"], ["Jose"])]
    assert {r.k: r.tp for r in assemble.fuzzy_hits(spark.createDataFrame(sets, "k int, gold array<string>, pred array<string>"), "k").collect()} == {None: 1, 1: 0}


def test_fuzzy_words_of_whole_texts(spark, tmp_path):
    """All long words of a text count, with all their letters."""
    import duckdb

    from folio.plans import queries

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.choice([6, 7, 9, 12, 13, 15, 18])))
    words = [word() for _ in range(60)]
    text = lambda change: " ".join(changed(rng, w) if change else w for w in rng.sample(words, 25))
    rows = [(0, "a", "Firsts of all\nconstantinopolis"), (1, "a", "Seconds, constantinopolia"), (2, "b", "constantinople"), (3, "b", "constantinopxyzuvw"), (4, None, "Straße Martas"), (5, None, "no Martas"), (6, "c", None), (8, "c", ""), (9, "e", "x")]
    rows += [(k, "d", text(k % 2)) for k in range(10, 18)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.source: r.tp for r in queries.QUERIES["q_eval_fuzzy_words"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(queries.ORACLES["q_eval_fuzzy_words"]).fetchall())
    assert got["a"] == 1 and got["b"] == 0 and got[None] == 1 and got["c"] == got["e"] == 0 and got["d"] > 10


def test_scans(spark):
    rng, n = random.Random(6), 4
    rows = [(g, i, rng.random() < 0.2, rng.random() < 0.5) for g in (1, 2, None) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, i long, loud boolean, ok boolean")
    got = {(r.g, r.i): r.extract for r in routing.gate(df, "g", "i", F.col("loud"), F.lit(False), n, F.col("ok")).collect()}
    for g in (1, 2, None):
        quiet = 0
        for _, i, loud, ok in [r for r in rows if r[0] == g]:
            wanted = i == 0 or loud
            if not wanted:
                quiet += 1
                wanted = quiet >= n
            if wanted and ok:
                quiet = 0
            assert got[g, i] == wanted, (g, i)
    step = F.array(F.lit(1), F.lit(0))
    small = {(r.g, r.i): r.s for r in scan.states_before(df, ["g"], "i", step, 2, "s", size=7).collect()}
    assert len(small) == len(rows) and all(s == i % 2 for (_, i), s in small.items())
    sums = {(r.g, r.i): r.s for r in scan.sum_before(df, ["g"], "i", F.col("i"), "s", size=7).collect()}
    assert len(sums) == len(rows) and all(s == i * (i - 1) // 2 for (_, i), s in sums.items())


def plain_fold(rows, names=L.MOST_CHARACTERS):
    """The rules one update after the other."""
    out, state = {}, {}
    for book, n, voice, glossary, characters, decisions, scene, rejected in sorted(rows, key=lambda r: r[:2]):
        m = state.setdefault(book, {"voice": L.DEFAULT_VOICE, "glossary": {}, "characters": {}, "decisions": [], "scene": ""})
        m["voice"] = (voice or "").strip() or m["voice"]
        for x in rejected or []:
            m["characters"].pop(x, None)
        for k, v in (glossary or {}).items():
            m["glossary"].setdefault(k, v)
        for k, v in (characters or {}).items():
            if not k[0].isupper():
                continue
            if k not in m["characters"]:
                if len(m["characters"]) < names:
                    m["characters"][k] = v
            elif m["characters"][k] == L.GENERIC and v != L.GENERIC and (v or "").strip():
                m["characters"][k] = v
        for d in decisions or []:
            if d and not any(SequenceMatcher(None, d, e).ratio() >= L.SIMILAR for e in m["decisions"]):
                m["decisions"].append(d)
        m["decisions"] = m["decisions"][-L.MOST_DECISIONS :]
        m["scene"] = scene or m["scene"]
        out[book, n] = (m["voice"], dict(m["glossary"]), dict(m["characters"]), list(m["decisions"]), m["scene"])
    return out


def random_updates(seed, books=3, chunks=60):
    rng = random.Random(seed)
    names = ["Ana", "Bea", "Carlos", "Diego", "Eva", "bad"]
    rows = []
    for book in range(books):
        for n in range(chunks):
            some = lambda k: rng.sample(names, rng.randint(0, k))
            rows.append((
                book, n, rng.choice([None, "", " v%d " % n]), {x: str(n) for x in some(2)} or None, {x: rng.choice([L.GENERIC, L.GENERIC, "rich %d" % n, " "]) for x in some(3)},
                ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(rng.randint(0, 2))] + rng.choice([[], ["regla fija"], ["regla fijas"], [""]]), rng.choice([None, "", "s%d" % n]), some(2) if rng.random() < 0.4 else rng.choice([None, []]),
            ))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_is_that_of_one_update_after_the_other(spark, seed):
    rows = random_updates(seed)
    got = {(r.book, r.n): (r.voice, r.glossary, r.characters, r.decisions, r.last_scene) for r in M.fold(spark.createDataFrame(rows, UPDATE), "book", "n").collect()}
    assert got == plain_fold(rows)


def test_decisions_that_edits_tell_apart_are_not_compared_by_blocks(spark, monkeypatch):
    """Decisions of the same letters in another order, and those that are held already, need no search for common blocks."""
    said = ["abcdefgh ijklmnop", "ponmlkji hgfedcba", "abcdefgh ijklmnop", "hgfedcba ponmlkji"]
    rows = [(1, n, None, {}, {}, [d], "", []) for n, d in enumerate(said)]
    monkeypatch.setattr(similar, "ratio", lambda a, b: F.raise_error(F.lit("compared")).cast("double"))
    got = M.accepted_decisions(spark.createDataFrame(rows, UPDATE), "book", "n").orderBy("place").collect()
    assert [(r.n, r.text, r.place) for r in got] == [(0, said[0], 1), (1, said[1], 2), (3, said[3], 3)]


def test_similar_texts_are_within_the_edits(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcdeé ñ") for _ in range(rng.randint(1, 50)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "é", "ab"])
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similar.alike(F.col("a"), F.col("b")).alias("same")).collect()
    assert [r.same for r in got] == [SequenceMatcher(None, r.a, r.b).ratio() >= L.SIMILAR for r in got]
    assert {r.same for r in got} == {True, False}


def test_a_book_longer_than_a_slice(spark):
    rng = random.Random(9)
    rows = [(b, n, None, {}, {}, ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(3)], "", []) for b, chunks in ((1, 300), (2, 1)) for n in range(chunks)]
    got = {(r.book, r.n): r.decisions for r in M.fold(spark.createDataFrame(rows, UPDATE), "book", "n").collect()}
    assert got == {k: m[3] for k, m in plain_fold(rows).items()}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_names_of_a_full_memory(spark, most):
    rows = random_updates(7)
    # a dict's order is lost on its way to a map, and here it counts
    listed = [(*r[:4], list(r[4].items()), *r[5:]) for r in rows]
    df = spark.createDataFrame(listed, UPDATE.replace("characters map<string,string>", "characters array<struct<k:string,v:string>>")).withColumn("characters", F.map_from_entries("characters"))
    spans = M.character_changes(df, "book", "n", most).collect()
    for (book, n), m in plain_fold(rows, most).items():
        assert {s.name: s.what for s in spans if s.book == book and s.since <= n and (s.until is None or s.until > n)} == m[2], (book, n)


def test_fold_of_nothing_and_of_no_book(spark):
    assert M.fold(spark.createDataFrame([], UPDATE), "book", "n").collect() == []
    assert M.fold(spark.createDataFrame([(None, 0, "v", {}, {}, [], "", [])], UPDATE), "book", "n").collect() == []
    r = M.fold(spark.createDataFrame([(1, 0, None, None, None, None, None, None)], UPDATE), "book", "n").first()
    assert (r.voice, r.glossary, r.characters, r.decisions, r.last_scene) == (L.DEFAULT_VOICE, {}, {}, [], "")


def test_repeated_and_null_ids_are_texts_of_their_own(spark):
    rows = [(1, "Ana dijo. Diego miró."), (1, "Vino Diego. Diego dijo. Diego miró."), (None, "Vino Diego. Diego dijo."), (1, None), (1, "")]
    got = mentions.name_tokens(spark.createDataFrame(rows, "id int, text string"), "id").groupBy("id", "name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("start")).alias("s")).collect()
    assert {(r.id, r.name): (r.n, r.s) for r in got} == {(1, "Ana"): (1, [0]), (1, "Diego"): (4, [5, 10, 12, 24]), (1, "Vino"): (1, [0]), (None, "Diego"): (2, [5, 12]), (None, "Vino"): (1, [0])}


def test_prompts(spark):
    none = F.create_map().cast("map<string,string>")
    r = spark.range(1).select(
        prompts.prompt("fix", "en", "es", F.lit("v"), F.array(F.lit("d")), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), none, F.lit("")).alias("p"), T.fix_payload(F.lit(" "), F.lit(" x\n"), "en", "es").alias("f"),
        prompts.extraction(F.lit("o"), F.lit("t"), F.lit(""), F.array(F.lit("Ana"))).alias("e"), prompts.extraction(F.lit("o"), F.lit("t"), F.lit("n"), F.array().cast("array<string>")).alias("b"),
    ).first()
    assert "- a: 1\n- b: 2" in r.p and "Characters:\nnone" in r.p and "this is the beginning" in r.p and f"<original>\n{L.EMPTY}\n" in r.f
    assert "Candidates to confirm or reject:\n- Ana" in r.e and f"Notes: {L.NO_NOTES}" in r.e and "Candidates" not in r.b and "Notes: n" in r.b


def test_memory_json(spark):
    whole = json.dumps({"voice": "v", "decisions": ["d"], "glossary": {"a": "1"}, "characters": {"Ana": "x"}, "last_scene": "s"})
    rows = spark.createDataFrame([(1, whole), (2, "{bad"), (3, None), (4, '{"voice": "w"}'), (5, "[1]")], "id int, raw string")
    got = {r.id: r.m for r in rows.select("id", M.of_json(F.col("raw")).alias("m")).collect()}
    assert got[1].characters == {"Ana": "x"} and got[2] is None and got[3] is None and got[5] is None and got[4].decisions == [] and got[4].voice == "w"
    versions = spark.createDataFrame([(1, whole, 3), (2, whole, 1), (2, "{bad", 2)], "book_id int, memory string, version int")
    out = {(r.book_id, r.version) for r in M.based(versions, spark.createDataFrame([(1,), (2,), (7,)], "book_id int")).collect()}
    assert out == {(1, 3), (2, 1), (2, 2), (2, 3), (7, 1)}


def test_patterns_of_a_genre(spark):
    df = spark.createDataFrame([(1, "ESCENA 1\nA.\nActo 2\nB.")], "id int, text string")
    own = {"chapter": [r"(?i)^acto\s+\d+"], "scene": [r"^ESCENA"], "pov": []}
    assert [r.boundary_type for r in segment.segments(df, "id", patterns=own).orderBy("seg_no").collect()] == ["scene", "chapter"]


def test_memory_stream_equals_the_batch(spark, tmp_path):
    """Two micro-batches, the second by a query that goes on from the checkpoint, begun from memories of before."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "book_id long, chunk_index int, notes string, force boolean, update string"
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = {"voice": "before", "decisions": ["Mantener el tono"], "glossary": {"z": "0"}, "characters": {"Zoe": L.GENERIC, "Eva": "x"}, "last_scene": "old"}
    memories = spark.createDataFrame([(3, json.dumps(first), 7)], "book_id long, memory string, version int")
    said = [
        (1, 0, "", False, {"glossary": {"a": "1"}, "characters": {"Ana": "x", "Bea": "y"}, "decisions": ["Mantener el tono"]}), (1, 1, "", False, {"voice": "never"}), (2, 0, "", False, None),
        (3, 0, "", False, {"characters": {"Zoe": "rich"}, "decisions": ["Mantener el tono."], "rejected": ["Eva"]}),
        (1, 2, "un nuevo nombre", None, {"rejected": ["Bea"], "glossary": {"a": "2", "b": "3"}, "last_scene": "s"}), (2, 1, "", True, "{bad"), (3, 1, "", True, {"glossary": {"z": "9", "y": "1"}}),
    ]
    rows = [(*r[:4], r[4] if r[4] is None or isinstance(r[4], str) else json.dumps(r[4])) for r in said]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = S.memory_stream(spark.readStream.schema(schema).parquet(folder), memories)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = {(r.book_id, r.chunk_index): r for r in spark.read.parquet(out).collect()}
    assert [got[1, i].version for i in range(3)] == [1, 2, 3] and [got[1, i].extracted for i in range(3)] == [True, False, True] and got[2, 1].extracted and got[3, 1].version == 9
    assert (got[3, 1].voice, got[3, 1].characters, got[3, 1].glossary, got[3, 1].decisions, got[3, 1].last_scene) == ("before", {"Zoe": "rich"}, {"z": "0", "y": "1"}, ["Mantener el tono"], "old")
    # the same updates in one batch
    taken = [(k, i, u) for k, i, _, _, u in rows if got[k, i].extracted or u is None]
    taken += [(3, -1, json.dumps(first))] + [(k, i, None) for k, i, _, _, u in rows if not got[k, i].extracted and u is not None]
    df = spark.createDataFrame(taken, "book_id long, chunk_index int, update string").select("book_id", "chunk_index", reply.update(F.col("update")).alias("u")).select("book_id", "chunk_index", "u.*")
    for r in M.fold(kept(df), "book_id", "chunk_index").where("chunk_index >= 0").collect():
        g = got[r.book_id, r.chunk_index]
        assert (r.voice, r.glossary, r.characters, r.decisions, r.last_scene) == (g.voice, g.glossary, g.characters, g.decisions, g.last_scene), r


def test_resume_takes_each_file_once(spark, tmp_path):
    folder, target, check = (str(tmp_path / x) for x in ("in", "taken", "check"))
    spark.range(5).write.parquet(folder)
    for _ in range(2):
        S.resume(spark, folder, "id long", target, check)
        assert spark.read.parquet(target).count() == 5


def test_intake_survives_a_crash_and_renamed_copies(spark, tmp_path):
    folder, target, check = tmp_path / "in", str(tmp_path / "taken"), str(tmp_path / "check")
    folder.mkdir()
    stream = lambda: spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(folder)).select("path", "content")
    (folder / "a.txt").write_text("one")
    (folder / "b.txt").write_text("two")
    (folder / "b again.txt").write_text("two")

    def dies(rows, batch_id, *rest):
        S.take_batch(rows, batch_id, *rest)
        raise RuntimeError("killed after the write")

    with pytest.raises(Exception, match="killed"):
        S.intake(stream(), target, check, write=dies)
    assert spark.read.parquet(target).count() == 2  # written, but not committed
    S.intake(stream(), target, check)
    (folder / "a renamed.txt").write_text("one")
    (folder / "c.txt").write_text("three")
    S.intake(stream(), target, check)
    S.intake(stream(), target, check)
    rows = spark.read.parquet(target).collect()
    assert sorted(bytes(r.content) for r in rows) == [b"one", b"three", b"two"]


@pytest.fixture
def parrot():
    """Answers with its prompt in the notes; null for a text that is at fault."""

    def call(payload, prompt):
        answer = F.to_json(F.struct(payload.alias("translation"), F.when(F.contains(payload, F.lit("unsure")), 0.5).otherwise(0.9).alias("confidence"), F.concat(F.lit("seen: "), prompt).alias("notes")))
        return F.when(~F.contains(payload, F.lit("boom")), answer)

    return call


def test_run_in_waves(spark, tmp_path, parrot):
    texts = ["Entonces Diego dijo que no. Diego miró.", "Diego unsure.", "boom", "El resto de Diego."]
    rows = [(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "Algo."), (2, 1, "Nada.")]
    chunks = spark.createDataFrame(rows, "book_id long, book_index int, original string").withColumn("source_section", F.lit(0))
    log = str(tmp_path / "log")
    out = {(r.book_id, r.book_index): r for r in pipeline.run(chunks, parrot, log, wave=1).collect()}
    assert {k: r.status for k, r in out.items()} == {(1, 0): "done", (1, 1): "flagged", (1, 2): "flagged", (1, 3): "done", (2, 0): "done", (2, 1): "done"}
    # what the first chunk has left is in the prompt of the second, and only what its text names
    assert f"Diego: {L.GENERIC}" in out[1, 1].notes and "Diego" not in out[2, 1].notes and "Last scene: Algo." in out[2, 1].notes and out[1, 2].translated is None

    def never(payload, prompt):
        raise AssertionError("nothing is pending")

    assert pipeline.run(chunks, never, log, wave=1).count() == 6
    counts = {r.book_id: r for r in pipeline.summary(spark.read.parquet(f"{log}/chunks"), pipeline.logged(spark, log)).collect()}
    assert (counts[1].done, counts[1].flagged, counts[1].resumed) == (2, 2, True)
    assert pipeline.finished(spark.read.parquet(f"{log}/chunks").where("book_id = 1")).first().text.count(L.REVIEW_MARKER) == 1


def test_fix_and_polish(spark, parrot):
    source = spark.createDataFrame([(1, 0, "One two three."), (1, 1, "Four five six seven.")], "book_id long, book_index int, original string")
    drafts = spark.createDataFrame([(1, ["Uno dos tres.", "Cuatro cinco seis siete."])], "book_id long, sections array<string>")
    pairs = assemble.fix_chunks(source, drafts).orderBy("book_index")
    assert [(r.original, r.source) for r in pairs.collect()] == [("Uno dos tres.", "One two three."), ("Cuatro cinco seis siete.", "Four five six seven.")]
    base = pipeline._latest(spark, None)
    out = pipeline.answered(pairs, base, parrot, task="fix").orderBy("book_index").collect()
    assert "<original>\nOne two three.\n</original>" in out[0].translated and "against the en original" in out[0].notes
    out = pipeline.answered(source, base, parrot, task="polish").orderBy("book_index").collect()
    assert out[1].translated.startswith("TRADUCCIÓN EXISTENTE (es)")


def test_command_line(spark, tmp_path, capsys):
    book, draft = tmp_path / "book.txt", tmp_path / "draft.txt"
    book.write_text("Chapter 1\nOne two three.\nChapter 2\nFour five.")
    draft.write_text("Capítulo 1\nUno dos tres.\nCapítulo 2\nCuatro cinco.")
    out = lambda n: ["--out", str(tmp_path / n)]
    assert main(["translate", str(book), *out("a")]) == 0
    assert "resumed" not in capsys.readouterr().out
    assert main(["translate", str(book), *out("a")]) == 0
    said = capsys.readouterr().out
    assert "done already" in said and "resumed" in said
    assert main(["fix", str(book), *out("b")]) == 1  # no draft
    assert main(["fix", str(book), "--draft", str(draft), *out("b")]) == 0
    assert main(["polish", str(draft), *out("c")]) == 0
    assert spark.read.text(str(tmp_path / "a")).count() > 0 and spark.read.text(str(tmp_path / "b")).count() > 0
