"""Token-ID output: byte- or bit-plane shuffled, zstandard-compressed chunks with a chunk index.

A file holds the ids of documents in order. Ids are cut into chunks of a fixed
number; a chunk's ids are transposed into planes (all lowest bytes, then the next
ones, or the same by bits), each plane is one zstandard frame. Behind the chunks
come a document table (ids and lengths) and the index: for each chunk its number
of ids and the offset and size of each plane. The last 12 bytes are the index's
size and the magic word.

Documents are dealt out by ranges of their id and sorted, a file per task. File
names are new for every attempt and the manifest lists those of the tasks that
counted, so a lost executor leaves nothing that is read. Files are written and
read through the file system of the folder's URI.

Defined results: null and empty texts give the end id alone; rows with equal ids
follow each other, by a hash of the text; null ids come first.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from folio.llm.common import named, new_dir, small_batches, strings, written

MAGIC = b"FOLIOTK1"


def _kinds() -> np.ndarray:
    """By byte: 1 ASCII white space, 2 ASCII letter, 4 sign after which no letter's piece goes on, 8 last byte of other white space, 16 last byte of a letter behind C3."""
    kind = np.zeros(256, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 1
    kind[65:91] = kind[97:123] = 2
    kind[list(b".,;:!?")] = 4
    kind[[*range(0x1C, 0x20), *range(0x80, 0x8F), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] |= 8
    kind[0x80:0xC0] |= 16
    kind[[0x97, 0xB7]] &= 0xEF
    return kind


_KIND = _kinds()


class Encoder:
    """Ids of whole texts by a tokenizer file, each followed by the end id.

    A byte-level vocabulary with the common pattern never lets a piece reach over
    the start of white space, nor from a letter to one of ``.,;:!?``; so a text's
    ids are those of the parts between such places, one after the other. Parts
    repeat a lot: they are found in the bytes of many texts at once, known by 128
    bits, and the ids of known ones are gathered. New parts are encoded in long
    runs, in which the parts' ends are found by the tokens' numbers of bytes. With
    any other tokenizer whole texts are encoded. What is kept is bounded by a
    number of parts and of their ids; beyond it, it is learnt anew.
    """

    def __init__(self, path: str, end_id: int, most: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.end, self.most = Tokenizer.from_file(path), end_id, most
        told = json.loads(self.model.to_str())
        before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
        self.parted = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not told.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        added = told.get("added_tokens") or []
        self.special = [t["content"].encode() for t in added]
        self.odd = re.compile(b"|".join(re.escape(x) for t in self.special for x in (t[:2], t[-2:])) or b"(?!)").search
        # a token next to which white space goes would reach over the places
        self.parted = self.parted and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"[\s.,;:!?]", t["content"]) for t in added)
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max([0, *vocabulary.values(), *(t["id"] for t in added)]) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.known = 0
        self.table = np.full(1 << (4 * self.most - 1).bit_length(), -1, np.int32)
        self.names = np.zeros((2, 1024), np.uint64)
        self.at = np.zeros(1025, np.int64)
        self.ids = np.zeros(4096, "<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        cut = np.zeros(n, bool)
        kind = _KIND[data]
        latin = np.zeros(n, bool)  # behind C3
        latin[1:] = data[:-1] == 0xC3
        letter = (kind & 2).view(bool) | ((kind & 16).astype(bool) & latin)
        white = (kind & 1).view(bool)
        other = (kind & 8).astype(bool) & ~latin
        cut[1:] = (white[1:] & ~white[:-1] & ~other[:-1]) | ((kind[1:] & 4).astype(bool) & letter[:-1])
        cut[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], n)

    def _find(self, names: np.ndarray) -> np.ndarray:
        """Numbers of known parts, -1 of new ones."""
        out, left, probe = np.full(names.shape[1], -1, np.int64), np.arange(names.shape[1]), 0
        while len(left):
            found = self.table[((names[0, left] + np.uint64(probe)) & np.uint64(len(self.table) - 1)).astype(np.int64)]
            left, found = left[found >= 0], found[found >= 0]
            same = (self.names[0, found] == names[0, left]) & (self.names[1, found] == names[1, left])
            out[left[same]] = found[same]
            left, probe = left[~same], probe + 1
        return out

    def _keep(self, names: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        first, n = self.known, self.known + names.shape[1]
        if n > self.names.shape[1]:
            room = max(n, 2 * self.names.shape[1])
            self.names = np.pad(self.names, ((0, 0), (0, room - self.names.shape[1])))
            self.at = np.pad(self.at, (0, room + 1 - len(self.at)))
        self.names[:, first:n] = names
        self.at[first + 1 : n + 1] = self.at[first] + np.cumsum(counts)
        if self.at[n] > len(self.ids):
            self.ids = np.pad(self.ids, (0, max(self.at[n], 2 * len(self.ids)) - len(self.ids)))
        self.ids[self.at[first] : self.at[n]] = ids
        if 2 * n > len(self.table):
            self.table, first = np.full(1 << int(4 * n - 1).bit_length(), -1, np.int32), 0
        left, probe, self.known = np.arange(first, n), 0, n
        while len(left):
            place = ((self.names[0, left] + np.uint64(probe)) & np.uint64(len(self.table) - 1)).astype(np.int64)
            free = self.table[place] < 0
            self.table[place[free]] = left[free]
            left, probe = left[self.table[place] != left], probe + 1

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> None:
        raw = data.tobytes()
        parts = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
        # parts that can follow each other in a run: led by white space, and nothing at their ends that joins it
        head, tail, ahead = data[start], data[end - 1], data[np.maximum(end - 2, 0)]
        plain = ((_KIND[head] & 1) != 0) & (end - start > 1) & ((_KIND[tail] & 1) == 0) & (((_KIND[tail] & 8) == 0) | (ahead == 0xC3))
        if self.special:  # a run must not put together what is none in the text
            plain &= np.array([not self.odd(p) for p in parts], bool)
        order, ids, counts = np.flatnonzero(plain), [], []
        edges = np.cumsum((end - start)[order])
        cuts = np.searchsorted(edges, np.arange(1 << 16, edges[-1] + (1 << 16), 1 << 16), side="left") + 1 if len(order) else []
        run = 0
        for cut in cuts:  # one after the other: what the library returns is many times as large as the text
            these, run = order[run:cut], cut
            (got,) = self._ids([b"".join([parts[k] for k in these]).decode()])
            ends = np.searchsorted(np.cumsum(self.bytes_of[got]), np.cumsum((end - start)[these])) + 1
            ids.append(got)
            counts.append(np.diff(ends, prepend=0))
        alone = np.flatnonzero(~plain)
        for k in range(0, len(alone), 1024):
            single = self._ids([parts[i].decode() for i in alone[k : k + 1024]])
            ids += single
            counts.append(np.array([len(x) for x in single], np.int64))
        self._keep(names[:, np.concatenate([order, alone])], np.concatenate(ids), np.concatenate(counts))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column, the end id last; null like an empty text."""
        data, offsets = strings(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        end = np.array([self.end], "<u4")
        if not self.parted:
            return [np.concatenate([x, end]) for x in self._ids([t or "" for t in column.to_pylist()])]
        if not len(data):
            return [end] * len(column)
        if self.known > self.most or self.at[self.known] > 8 * self.most:
            self._clear()
        starts, ends = self._parts(data, offsets)
        names = np.stack(named(data, starts, ends))
        number = self._find(names)
        new = np.flatnonzero(number < 0)
        if len(new):
            _, firsts = np.unique(names[0, new], return_index=True)
            new = new[firsts]
            self._learn(data, starts[new], ends[new], names[:, new])
            lost = np.flatnonzero(number < 0)
            number[lost] = self._find(names[:, lost])
        counts = self.at[number + 1] - self.at[number]
        after = np.cumsum(counts)
        ids = self.ids[np.repeat(self.at[number] - after + counts, counts) + np.arange(after[-1])]
        bounds = np.concatenate([[0], after])[np.searchsorted(starts, offsets)]
        return [np.concatenate([ids[a:b], end]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        out = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")


class FileWriter:
    def __init__(self, stream, chunk: int, bits: bool, level: int):
        self.stream, self.chunk, self.bits = stream, chunk, bits
        self.pack = zstandard.ZstdCompressor(level=level)
        self.open: list[np.ndarray] = []
        self.waiting, self.at = 0, 0
        self.index: list[list] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.open.append(ids)
        self.waiting += len(ids)
        while self.waiting >= self.chunk:
            whole = np.concatenate(self.open)
            self._chunk(whole[: self.chunk])
            self.open, self.waiting = [whole[self.chunk :]], len(whole) - self.chunk

    def _put(self, data: bytes) -> list[int]:
        data = self.pack.compress(data)
        self.stream.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def _chunk(self, ids: np.ndarray) -> None:
        self.index.append([len(ids), [self._put(p) for p in to_planes(ids, self.bits)]])

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.concatenate(self.open))
        null = [k for k, (d, _) in enumerate(self.docs) if d is None]
        names = self._put(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        sizes = self._put(np.array([n for _, n in self.docs], "<i8").tobytes())
        index = json.dumps({"chunks": self.index, "docs": [names, sizes], "null": null}).encode()
        self.stream.write(index + len(index).to_bytes(4, "little") + MAGIC)
        self.stream.close()


class FileReader:
    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file, or not whole")
        n = int.from_bytes(tail[:4], "little")
        self.index = json.loads(file.read_at(n, size - 12 - n))
        self.unpack = zstandard.ZstdDecompressor()

    def _get(self, at: list[int]) -> bytes:
        return self.unpack.decompress(self.file.read_at(at[1], at[0]))

    def chunk(self, k: int) -> np.ndarray:
        n, planes = self.index["chunks"][k]
        return from_planes([self._get(p) for p in planes], n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        names, sizes = (np.frombuffer(self._get(p), "<i8").tolist() for p in self.index["docs"])
        null, have, k = set(self.index["null"]), np.zeros(0, "<u4"), 0
        for i, (name, size) in enumerate(zip(names, sizes)):
            parts, need = [], size
            while need > len(have):
                parts.append(have)
                need -= len(have)
                have, k = self.chunk(k), k + 1
            parts.append(have[:need])
            have = have[need:]
            yield (None if i in null else name), np.concatenate(parts)


def _runs(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``limit`` bytes, one at least."""
    offsets, i = strings(texts)[1], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


_ENCODERS: dict[tuple, Encoder] = {}


def _write(folder: str, path: str, end_id: int, chunk: int, bits: bool, level: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _ENCODERS:
            _ENCODERS[path, end_id] = Encoder(path, end_id)
        encoder = _ENCODERS[path, end_id]
        fs, where = pyarrow.fs.FileSystem.from_uri(folder)
        name, writer, n = f"ids-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}", None, 0
        for batch in batches:
            for i, j in _runs(batch.column("_text")):
                part = batch.slice(i, j - i)
                if writer is None:
                    fs.create_dir(where, recursive=True)
                    writer = FileWriter(fs.open_output_stream(f"{where}/{name}"), chunk, bits, level)
                for doc_id, ids in zip(part.column("_id").to_pylist(), encoder.encode(part.column("_text"))):
                    writer.add(doc_id, ids)
                    n += len(ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([n], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    return of


def write_token_ids(df: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, chunk: int = 1 << 16, bits: bool = False, level: int = 1) -> DataFrame:
    """Writes the files and returns the manifest, a row per file in the order of documents: part, path, n_docs, n_ids, start."""
    small_batches(df.sparkSession)
    folder = folder or new_dir(df.sparkSession, "token-ids")
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # rows of one id, or without one, are dealt on by their text, and equal ones by their place
    docs = docs.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    docs = docs.repartitionByRange("_id", "_hash", "_row").sortWithinPartitions("_id", "_hash", "_row").select("_id", "_text")
    files = written(docs.mapInArrow(_write(folder, tokenizer_path, end_id, chunk, bits, level), "part int, path string, n_docs long, n_ids long"), "manifest")
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    return written(files.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))), "manifest")


def _read(digests: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, where = pyarrow.fs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(where) as file:
                    out, held, start = [], 0, row["start"]
                    for doc_id, ids in FileReader(file).documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)) if digests else ids.tobytes()))
                        start, held = start + len(ids), held + len(ids)
                        if held > 1 << 21:
                            yield _batch(out, digests)
                            out, held = [], 0
                    if out:
                        yield _batch(out, digests)

    return of


def _batch(rows: list[tuple], digests: bool) -> pa.RecordBatch:
    ids, start, n, last = zip(*rows)
    last = pa.array(last, pa.int64() if digests else pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])


def read_token_ids(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """Documents of the files, a task per file: doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian 32-bit); or, in place of the ids, their unsigned crc32 as ids_crc32."""
    files = max(1, manifest.count())
    last = "ids_crc32 long" if digests else "ids binary"
    return manifest.select("path", "start").repartition(files).mapInArrow(_read(digests), f"doc_id long, start long, n_tokens long, {last}")


@F.arrow_udf(T.LongType())
def crc32(ids: pa.Array) -> pa.Array:
    return pa.array([None if x is None else zlib.crc32(x) for x in ids.to_pylist()], pa.int64())
