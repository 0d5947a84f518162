"""Literal rows through the engine's functions and operators."""

import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.cli import main
from folio.functions import reply
from folio.functions import text as T
from folio.operators import assemble, memory, mentions, pack, routing, segment, state
from folio.plans import pipeline, queries
from folio.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalar_functions(spark):
    lit = F.lit
    r = one(
        spark,
        T.est_tokens(lit("uno dos  tres\n")).alias("est"), T.title_of(lit("\n# My Book\nx"), lit("stem")).alias("title"), T.title_of(lit("It ends.\n"), lit("stem")).alias("stem"),
        T.slug(lit(" My  Book: 2! ")).alias("slug"), T.truncated(lit("a  b " * 60), 20).alias("cut"), T.folded(lit(" José Ñ ")).alias("folded"), T.valid_name(lit("Ana María")).alias("name"),
        T.valid_name(lit("El")).alias("noise"), T.scene_digest(lit("One. Two! Three.")).alias("digest"), T.voice(lit("yo me fui con mi casa")).alias("voice"), T.status_of(lit(0.75)).alias("status"),
        T.html_to_text(lit("<p>a&amp;lt;b</p><link>c<script>d</script>")).alias("html"), T.style_decisions(lit("Mantener tono. Nada. Voz clara")).alias("style"), T.valid_language(lit("--")).alias("lang"),
    )
    assert (r.est, r.title, r.stem, r.slug, r.folded, r.name, r.noise, r.digest) == (3, "My Book", "stem", "my_book_2", "jose n", True, False, "One. Two!")
    assert len(r.cut) <= 20 and r.cut.endswith("…") and r.voice.startswith("narrador en primera persona") and r.status == "done"
    assert r.html == "a<b\ncd" and r.style == ["Mantener tono", "Voz clara"] and not r.lang


def test_segments(spark):
    text = "Intro line\nChapter 1\nBody one.\n***\nBody two.\n\n\nBody three.\n*Mara*\nEnd."
    got = segment.segments(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("seg_no").collect()
    assert [r.boundary_type for r in got] == ["paragraph", "chapter", "scene", "scene", "pov"]
    assert all(text[r.original_position :].lstrip().startswith(r.text.split("\n")[0]) for r in got)


def test_packing_keeps_words_and_limits(spark):
    text = "\n\n".join(" ".join(f"w{i}x{j}." for j in range(30)) for i in range(12))
    df = spark.createDataFrame([(text,)], "text string")
    pieces = df.select(F.explode(pack.split_large(F.col("text"), 100)).alias("p")).collect()
    assert " ".join(r.p for r in pieces).split() == text.split() and len(pieces) == 6
    edge = df.select(pack.split_large(F.lit(" ".join(["w"] * 154)), 200).alias("a")).first()
    assert len(edge.a) == 1  # 154 words are 200 tokens
    segs = [("a", "paragraph", 0, 50), ("b", "scene", 5, 60), ("c", "chapter", 9, 10), ("d", "scene", 12, 10)]
    rows = spark.createDataFrame([(segs,)], "s array<struct<text:string,boundary_type:string,position:int,tokens:int>>")
    assert [x.text for x in rows.select(pack.merged_small(F.col("s"), 100, 200).alias("m")).first().m] == ["a\n\nb", "c", "d"]


def test_packed_lines_keep_digits_and_lose_blanks(spark, tmp_path):
    """No line loses a sign that happens to be its number, and blanks at its ends go."""
    texts = [(1, "0 zero\n1 one 1\n  two \n   \n44 four\n6"), (2, "007\n"), (3, None), (4, "  ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.QUERIES["q_pack_lines_200"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(1, 0, "0 zero\n\n1 one 1\n\ntwo\n\n44 four\n\n6"), (2, 0, "007")]


def test_mentions(spark):
    texts = [(1, "Entonces Diego dijo que no. El señor Duarte llegó. Fueron los ejércitos de Tempest."), (2, "Sombra. Luego vino Ana y vio a Ana."), (3, None)]
    got = mentions.character_mentions(spark.createDataFrame(texts, "id int, text string"), "id").collect()
    names = {(r.id, r.name) for r in got}
    assert {(1, "Diego"), (1, "Duarte"), (2, "Ana")} <= names and (1, "Tempest") not in names


@pytest.mark.parametrize(
    "raw, exp",
    [
        ('{"translation": " hola ", "confidence": 2, "notes": "n"}', ("hola", 1.0, "n")),
        ('```json\n{"text": "x", "confidence": "0.4"}\n```', ("x", 0.4, L.NO_NOTES)),
        ('Sure: {"result": "y", "extra": {"a": 1}} done', ("y", 0.5, L.NO_NOTES)),
        ("## Traducción\nHola.\n## Confianza\n0.8\n## Notas\nbien", ("Hola.", 0.8, "bien")),
    ],
)
def test_replies(spark, raw, exp):
    assert tuple(one(spark, reply.parsed(F.lit(raw)).alias("r")).r) == exp


def test_unstructured_reply(spark):
    r = one(spark, reply.parsed(F.lit("# Head\n**bold** text")).alias("r")).r
    assert r.translation == "Head\nbold text" and r.confidence == 0.3


def test_memory_rules(spark):
    u = "book int, n int, voice string, glossary map<string,string>, characters map<string,string>, decisions array<string>, last_scene string, rejected array<string>"
    rows = [
        (1, 0, None, {"a": "1"}, {"Ana": L.GENERIC, "el": "x"}, ["Mantener el tono formal"], "first", []),
        (1, 1, " v ", {"a": "2", "b": "3"}, {"Ana": "the captain"}, ["Mantener el tono formal."], None, []),
        (1, 2, None, {}, {"Ana": "other"}, ["Otra cosa"], "x" * 1000, ["Nobody"]),
        (1, 3, None, {}, {}, [], "", ["Ana"]),
    ]
    got = memory.fold(spark.createDataFrame(rows, u), "book", "n").orderBy("n").collect()
    assert got[2].glossary == {"a": "1", "b": "3"} and got[2].characters == {"Ana": "the captain"} and got[2].decisions == ["Mantener el tono formal", "Otra cosa"]
    assert got[1].voice == "v" and got[1].last_scene == "first" and len(got[3].last_scene) == 420 and got[3].characters == {}


def test_relevant_terms_of_any_length(spark):
    texts = [(1, "Él vio a 李 en Oz."), (2, "A"), (3, ""), (4, None), (5, "oZ oz aaaa")]
    names = [(i, t) for i, t in enumerate(["", "a", "É", "李", "oz", "Z.", "aaa", "vio a", "q", "qq", None])]
    chunks, terms = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "n int, term string")
    exp = sorted((i, n) for i, x in texts for n, t in names if x is not None and t is not None and t.lower() in x.lower())
    for most in (1, 100):
        assert sorted((r.id, r.n) for r in memory.relevant_terms(chunks, terms, most=most).collect()) == exp


def test_state_and_routing(spark):
    events = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "done"), (2, 1, "b", "flagged")], "chunk int, seq int, text string, status string")
    assert {(r.chunk, r.text, r.status) for r in state.latest_set(events, "chunk").collect()} == {(1, "a", "done"), (2, "b", "flagged")}
    books = spark.createDataFrame([("h",)], "file_hash string")
    with pytest.raises(state.DuplicateBook):
        state.insert_books(books, books)
    calls = spark.createDataFrame([(1, i, 10) for i in range(6)], "book int, n int, tokens int")
    plan = routing.plan(calls, [("b", 2, 15), ("a", 1, 15)], "book", "n", "tokens")
    assert [r.model for r in plan.orderBy("n").collect()] == ["a", "a", "b", "b", None, None]
    assert routing.pause_points(plan, "book", "n").count() == 4


def test_alignment(spark):
    draft = "Uno dos tres. Cuatro cinco seis. Siete ocho nueve."
    r = one(spark, assemble.aligned(F.lit(draft), F.array(F.lit(14), F.lit(18), F.lit(17))).alias("p")).p
    assert r == ["Uno dos tres.", "Cuatro cinco seis.", "Siete ocho nueve."]
    pages = one(spark, assemble.page_words(F.lit(draft), F.array(F.lit(3), F.lit(6))).alias("p")).p
    assert pages == ["Uno dos tres.", "Cuatro cinco seis. Siete ocho nueve."]


def paged(text, counts):
    w, out, start = text.split(), [], 0
    for c in counts[:-1]:
        t = min(start + round(c / sum(counts) * len(w)), len(w))
        places = [*range(t, min(len(w), t + 20)), *range(t, max(0, t - 20), -1)]
        t = next((i for i in places if i > 0 and w[i - 1].rstrip("\"'»)").endswith((".", "!", "?"))), t)
        out.append(" ".join(w[start:t]))
        start = t
    return [*out, " ".join(w[start:])] if w else [""] * len(counts)


def test_page_distribution_of_long_texts(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["uno", "dos", "tres", "fin.", "sí!»", "no?"] if k % 2 else ["uno"] * 30 + ["fin."]) for _ in range(n)) for k, n in enumerate([0, 1, 2, 5, 60, 300, 1999, 2000, 2001, 30000])]
    spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.QUERIES["q_page_distribution"](spark, str(tmp_path)).orderBy("doc_id", "page").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {k: paged(t, [120, 80, 200]) for k, t in [*enumerate(texts), (99, "")]}


def test_sources_and_pipeline(spark, tmp_path):
    book = tmp_path / "a book.txt"
    book.write_bytes("Chapter 1\nEl ni\xf1o.\nChapter 2\nFin.".encode("latin-1"))
    r = files.read_book(spark, str(book)).first()
    assert r.sections == ["Chapter 1\nEl niño.", "Chapter 2\nFin."] and r.title == "Chapter 1"
    epub = tmp_path / "b.epub"
    with zipfile.ZipFile(epub, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:language>EN</dc:language></metadata><manifest><item href="c.xhtml" media-type="application/xhtml+xml"/><item href="1.xhtml" media-type="application/xhtml+xml"/></manifest></package>')
        z.writestr("o/c.xhtml", "<p>cover</p>")
        z.writestr("o/1.xhtml", "<p>" + "word " * 60 + "</p>")
    r = files.read_book(spark, str(epub)).first()
    assert (r.title, r.detected_language, len(r.sections)) == ("T", "en", 1)
    with pytest.raises(files.UnsupportedFormat):
        files.reader_of("x.doc")
    with pytest.raises(FileNotFoundError):
        files.read_book(spark, str(tmp_path / "none.txt"))
    assert main(["translate", str(tmp_path / "none.txt")]) == 1

    def model(payload, prompt):
        return F.when(~F.contains(payload, F.lit("Fin")), pipeline.offline(payload, prompt))

    books = files.read_book(spark, str(book)).withColumn("book_id", F.lit(1).cast("long"))
    done = pipeline.run(pipeline.book_chunks(books), model, str(tmp_path / "log")).cache()
    assert sorted((r.status, r.translated is None) for r in done.collect()) == [("done", False), ("flagged", True)]
    assert pipeline.finished(done).first().text == "Chapter 1\nEl niño." + "\n" * 6 + L.REVIEW_MARKER + "Chapter 2\nFin."
    assert files.models([{"name": "a"}, {"name": "b", "priority": 1}])[0]["name"] == "b"


def test_folding_beyond_latin_1(spark):
    names = ["Éowyn", "Dvořák", "Nguyễn", "Ἀχιλλεύς", "Йорик", "Zoé", " ŽELJKO ", "Łukasz", "straße", "", None]
    got = [r.f for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(T.folded(F.col("n")).alias("f")).collect()]

    def plain(name):
        return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().strip()

    assert got == [None if n is None else plain(n) for n in names]
    assert got[:6] == ["eowyn", "dvorak", "nguyen", "αχιλλευς", "иорик", "zoe"]


def test_contexts_are_taken_before_the_shuffle(spark):
    """Contexts and ends of sentences at short, long and blank gaps; no window gathers lists of neighbours."""
    texts = ["Ana Ana Ana Eva. Ana", "", "x" * 90 + " Ana" + " " * 60 + "Eva!\u00a0\u2003Bob\nLeo dijo", "\u00a0 Ana", " ".join(["Ana"] * 40), "aAna Ana_ \u00d1and\u00fa?Ana"]
    exp = []
    for k, t in enumerate(texts):
        for m in re.finditer(rf"(?<!\w){L.NAME}(?!\w)", t):
            head = t[: m.start()].rstrip()
            exp.append((k, m[0], m.start(), t[max(0, m.start() - 42) : m.start()], t[m.end() : m.end() + 42], head == "" or head[-1] in ".!?"))
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "id int, text string")
    assert sorted(map(tuple, mentions.name_tokens(df, "id").collect())) == sorted(exp)
    told = mentions.evidence(df, "id")
    dealt = [x for x in told._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert len(dealt) == 1 and "collect_list" not in dealt[0]
    assert {(r.name, r.start) for r in told.where("speech").collect()} == {("Leo", texts[2].index("Leo"))}


def test_known_names_meet_by_folded_spelling(spark):
    """A text's decomposed spelling and a known name with marks outside Latin-1 are one name."""
    counted = spark.createDataFrame([(1, "dvorak", 1, 0, "Dvorak", 0, 0, 0, 0, 0)], "id int, norm string, occurrences long, first_index int, display string, sentence_start_hits long, speech_hits long, action_hits long, title_hits long, genitive_hits long")
    known = spark.createDataFrame([(1, "Dvořák")], "id int, name string")
    assert [tuple(r) for r in mentions.ranked(counted, "id", known=known).collect()] == [(1, 1, "Dvořák", 101, 1)]
