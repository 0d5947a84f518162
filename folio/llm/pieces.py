"""Tokens of many texts at once by their parts, for the operators that need tokens' bytes or counts.

The parts and their store are those of the token-id files (``token_ids.Encoder``);
here are the ids without an end id, the bytes behind each id, and the same for
sentencepiece models.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folio.llm.common import named, strings
from folio.llm.token_ids import Encoder

SPACE = "▁"


def led_by_space(column: pa.Array) -> pa.Array:
    """A space before each text; nothing for null and empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    some = pc.fill_null(pc.greater(pc.binary_length(column), 0), False)
    return pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())), pa.scalar("", pa.large_string()))


def byte_level_signs() -> dict[str, int]:
    """By sign of a byte-level vocabulary its byte: visible Latin-1 stands for itself, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel(Encoder):
    """A byte-level tokenizer file; special tokens' strings inside texts are plain text."""

    def __init__(self, path: str, most: int = 1 << 20):
        super().__init__(path, 0, most)
        if not self.parted:
            raise ValueError("a byte-level BPE file with the common pattern is needed")
        self.model.encode_special_tokens = True
        signs = byte_level_signs()
        self.spelled = [b""] * len(self.bytes_of)
        for token, k in self.model.get_vocab(with_added_tokens=False).items():
            self.spelled[k] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self._spell()

    def _spell(self) -> None:
        self.bytes_of = np.array([len(b) for b in self.spelled], np.int64)
        self.spell_at = np.cumsum(self.bytes_of) - self.bytes_of
        self.spelling = np.frombuffer(b"".join(self.spelled), np.uint8)

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is kept of all parts, one after the other, and where each text's begin and end."""
        if not len(data):
            return self.ids[:0], np.zeros(len(offsets), np.int64)
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
            rest = np.flatnonzero(number < 0)  # the first half of the name is another part's too
            if len(rest):
                _, firsts = np.unique(names[:, rest], axis=1, return_index=True)
                rest = rest[firsts]
                self._learn(data, starts[rest], ends[rest], names[:, rest])
                lost = np.flatnonzero(number < 0)
                number[lost] = self._find(names[:, lost])
        counts = self.at[number + 1] - self.at[number]
        after = np.cumsum(counts)
        got = self.ids[np.repeat(self.at[number] - after + counts, counts) + np.arange(after[-1])]
        return got, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, joined."""
        n = self.bytes_of[ids]
        after = np.cumsum(n)
        return self.spelling[np.repeat(self.spell_at[ids] - after + n, n) + np.arange(after[-1] if len(n) else 0)]

    def whole(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """By text: whether its tokens' bytes, joined, are its bytes."""
        joined = self.spelt(ids)
        if len(joined) == len(data) and np.array_equal(joined, data):
            return np.ones(len(offsets) - 1, bool)
        at = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])[bounds]
        return np.array([np.array_equal(joined[a:b], data[s:e]) for a, b, s, e in zip(at, at[1:], offsets, offsets[1:])], bool)


class Pieces(ByteLevel):
    """A sentencepiece BPE model with byte fallback, without its leading space: texts come with theirs.

    No piece reaches over the start of a run of spaces or holds a line feed, so a
    text's pieces are those of the parts between such places. A model of which that
    is not true, or that changes texts, is refused.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        normal = [p.piece for p in proto.pieces if p.type == kinds.NORMAL]
        over = any(re.search(f"[^{SPACE}]{SPACE}|[\n ]", p) for p in normal)
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or over or any(p.type == kinds.USER_DEFINED for p in proto.pieces) or not proto.trainer_spec.byte_fallback or proto.trainer_spec.model_type != 2:
            raise ValueError("a BPE model with byte fallback that leaves texts as they are is needed")
        spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.normal, self.longest, self.most = set(normal), max(map(len, normal)), most
        self.spelled = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in proto.pieces]
        self._spell()
        self._clear()

    @staticmethod
    def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        cut = np.zeros(n, bool)
        space, feed = data == 32, data == 10
        cut[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], n)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> None:
        raw = data.tobytes()
        for k in range(0, len(start), 4096):
            got = [self.of_part(raw[s:e].decode()) for s, e in zip(start[k : k + 4096].tolist(), end[k : k + 4096].tolist())]
            self._keep(names[:, k : k + 4096], np.concatenate(got), np.array([len(x) for x in got], np.int64))

    def of_part(self, part: str) -> np.ndarray:
        return np.array(self.model.encode(part, num_threads=1), "<u4")


_HELD: dict[tuple, ByteLevel] = {}


def held(kind: type, path: str) -> ByteLevel:
    """A worker's own, made once."""
    if (kind, path) not in _HELD:
        _HELD[kind, path] = kind(path)
    return _HELD[kind, path]


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = strings(column)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
