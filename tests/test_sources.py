"""Readers of one's own, page tables, model settings and written books, on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from folio.operators import assemble, memory
from folio.sources import files


def test_own_reader_comes_first(monkeypatch):
    monkeypatch.setattr(files, "READERS", list(files.READERS))
    own = lambda rows: rows
    files.register(lambda extension: extension == ".txt", own)
    assert files.reader_of("a.TXT") is own and files.reader_of("a.md") is not own


def test_page_tables(spark):
    pages = [(1, 0, "Chapter 1\none two three four"), (1, 1, "short"), (1, 2, "more of the first chapter here"), (1, 3, "CHAPTER 2\nfive six seven eight"), (2, 0, "no chapter is in this book")]
    df = spark.createDataFrame(pages, "book_id long, page_no int, text string")
    got = {(r.book_id, r.section_idx): (r.title, r.text) for r in files.pdf_books(df, F.lit("stem")).collect()}
    assert got == {
        (1, 0): ("Chapter 1", "Chapter 1\none two three four\n\nmore of the first chapter here"),
        (1, 1): ("Chapter 1", "CHAPTER 2\nfive six seven eight"),
        (2, 0): ("no chapter is in this book", "no chapter is in this book"),
    }


def test_model_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("FOLIO_TEST_KEY", "k")
    (tmp_path / "m").write_text(json.dumps({"models": [{"name": "a", "api_key": "${FOLIO_TEST_KEY}"}, {"name": "b", "priority": 1}, {"name": "c", "priority": 1}]}))
    got = files.read_models(str(tmp_path / "m"))
    assert [m["name"] for m in got] == ["b", "c", "a"] and got[2]["api_key"] == "k" and (got[2]["daily_token_limit"], got[2]["timeout_seconds"], got[2]["temperature"]) == (80_000, 60, 0.3)


def test_books_without_chunks_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        assemble.write_books(spark.createDataFrame([], "name string, text string"), str(tmp_path / "o"))


def test_last_decisions_and_emptiness(spark):
    r = spark.range(1).select(memory.recent(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda x: x.cast("string")), 3).alias("r"), memory.recent(F.array(F.lit("a")), 3).alias("s")).first()
    assert r.r == ["8", "9", "10"] and r.s == ["a"]
    rows = spark.createDataFrame([(1, memory.BASE_JSON), (2, json.dumps(json.loads(memory.BASE_JSON) | {"glossary": {"a": "b"}}))], "id int, m string")
    assert [x.e for x in rows.select(memory.is_empty(memory.of_json(F.col("m"))).alias("e")).collect()] == [True, False]
