"""Books from files: dispatch by extension, text with a fallback encoding, EPUB as a Python data source, model lists."""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions import text as T
from folio.operators import segment


class UnsupportedFormat(ValueError):
    pass


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 for the whole file where it is not valid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def text_books(files: DataFrame) -> DataFrame:
    """(title, source_path, detected_language, sections) of text files read as binaryFile."""
    text = decoded(F.col("content"))
    rows = files.select("path", text.alias("text"))
    marked = rows.where(segment.has_markers(F.col("text")))
    split = segment.sections(marked, "path").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "text"))), lambda s: s["text"]).alias("s"))
    rows = rows.join(split, "path", "left")
    sections = F.coalesce("s", segment.paragraph_sections(F.col("text")))
    return rows.select(T.title_of(F.col("text"), _stem(F.col("path"))).alias("title"), F.col("path").alias("source_path"), F.lit(None).cast("string").alias("detected_language"), sections.alias("sections"))


_OPF = "{http://www.idpf.org/2007/opf}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_ITEM = pa.schema([("path", pa.string()), ("title", pa.string()), ("language", pa.string()), ("item_no", pa.int32()), ("html", pa.string())])


def epub_items(content: bytes) -> tuple[str | None, str | None, list[str]]:
    """Title, language and the document items, in the order of the manifest."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in root.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        first = lambda name: next((e.text.strip() for e in package.iter(_DC + name) if e.text and e.text.strip()), None)
        items = []
        for e in package.iter(_OPF + "item"):
            if e.attrib.get("media-type") == "application/xhtml+xml":
                raw = z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(e.attrib["href"]))))
                try:
                    items.append(raw.decode("utf-8"))
                except UnicodeDecodeError:
                    items.append(raw.decode("latin-1"))
        language = first("language")
        return first("title"), language.lower() if language else None, items


def _epub_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            title, language, items = epub_items(content)
            yield pa.RecordBatch.from_pylist([{"path": path, "title": title, "language": language, "item_no": k, "html": h} for k, h in enumerate(items)], _ITEM)


def epub_books(files: DataFrame, least_words: int = 50) -> DataFrame:
    """Items of fewer words, such as covers, go; a missing title is the file's stem."""
    rows = files.select("path", "content").mapInArrow(_epub_rows, "path string, title string, language string, item_no int, html string")
    rows = rows.withColumn("text", T.html_to_text(F.col("html"))).where(F.size(T.words(F.col("text"))) >= least_words)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("item_no", "text"))), lambda s: s["text"])
    return rows.groupBy("path").agg(F.first("title").alias("t"), F.first("language").alias("detected_language"), texts.alias("sections")).select(F.coalesce("t", _stem(F.col("path"))).alias("title"), F.col("path").alias("source_path"), "detected_language", "sections")


#: Readers by extension, the first that takes it wins; ``register`` puts new ones first.
READERS: list[tuple[Callable[[str], bool], Callable[[DataFrame], DataFrame]]] = [(lambda e: e == ".epub", epub_books), (lambda e: e in (".txt", ".md"), text_books)]


def register(takes: Callable[[str], bool], reader: Callable[[DataFrame], DataFrame]) -> None:
    READERS.insert(0, (takes, reader))


def reader_of(path: str) -> Callable[[DataFrame], DataFrame]:
    extension = os.path.splitext(path)[1].lower()
    for takes, reader in READERS:
        if takes(extension):
            return reader
    raise UnsupportedFormat(f"{extension or path}: not one of {', '.join(L.EXTENSIONS)}")


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """A book as (title, source_path, detected_language, sections)."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return reader_of(path)(spark.read.format("binaryFile").load(path))


def pdf_books(pages: DataFrame, title: Column) -> DataFrame:
    """Books of page tables (book_id, page_no, text), as text extractors give them."""
    first = pages.groupBy("book_id").agg(F.min_by("text", "page_no").alias("text")).select("book_id", T.title_of(F.col("text"), title, 12).alias("title"))
    return segment.page_sections(pages).join(first, "book_id")


def models(rows: list[dict]) -> list[dict]:
    """Model settings with defaults and ``${NAME}`` taken from the environment, by priority."""
    full = lambda v: re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), v) if isinstance(v, str) else v
    out = [{"priority": 99, "daily_token_limit": 80_000, "timeout_seconds": 60, "temperature": 0.3} | {k: full(v) for k, v in r.items()} for r in rows]
    return sorted(out, key=lambda r: r["priority"])


def read_models(path: str) -> list[dict]:
    """Model settings of a file with a list ``models``, as YAML where its library is there, else as JSON."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return models(json.loads(text).get("models") or [])
    return models(yaml.safe_load(text).get("models") or [])


def check_arguments(path: str, source: str, target: str) -> None:
    """What a command line must hold before work begins."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    if os.path.splitext(path)[1].lower() not in L.EXTENSIONS:
        raise UnsupportedFormat(path)
    for code in (source, target):
        if not code or len(code) > 10 or not code.replace("-", "").isalpha():
            raise ValueError(f"not a language code: {code!r}")
    if source == target:
        raise ValueError("source and target are the same language")
