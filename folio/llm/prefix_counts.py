"""Token counts at every prefix of a text, by dynamic programming.

In a BPE vocabulary the tokens of a prefix are the tokens of a shorter prefix and
one token more: the one that ends the prefix and can stand behind the shorter
prefix's last token, that is, both together are split into just these two. Exactly
one of the vocabulary's tokens that end there can. So the last token and the count
of every prefix follow from those of shorter ones, and no prefix is encoded.

A text's table has for each of its code points how the count changes with it (it
may fall: two tokens become one). Parts of texts between places that no token
reaches over are counted once a worker and their changes are put one after the
other. ``tokens_at`` and ``chars_within`` answer from a table how many tokens a
prefix has and how much of a text fits a budget, without the tokenizer.

Defined results: null and empty texts have no tokens and an empty table; the sign
U+2581 is the tokenizer's own for a space and counts as one; rows with equal or null
ids are rows of their own; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches
from folio.llm.pieces import SPACE, Pieces, bytes_and_offsets, held, led_by_space
from folio.llm.token_ids import _runs


class PrefixCounts(Pieces):
    """Keeps for each part the changes of the count with each of its characters."""

    def _clear(self) -> None:
        super()._clear()
        self.ids = np.zeros(4096, np.int32)
        self.fits: dict[tuple[str, str], bool] = {}

    def of_part(self, part: str) -> np.ndarray:
        s = part.replace(" ", SPACE)
        if len(self.fits) > self.most:
            self.fits = {}
        fits, normal, split = self.fits, self.normal, self.model.encode
        last, count = [""], [0]
        for i in range(1, len(s) + 1):
            sign = s[i - 1]
            if sign not in normal:  # told byte by byte, and joined with nothing
                last.append("")
                count.append(count[-1] + len(sign.encode()))
                continue
            for n in range(min(self.longest, i), 0, -1):
                token = s[i - n : i]
                if token not in normal:
                    continue
                before = last[i - n]
                ok = fits.get((before, token))
                if ok is None:
                    # behind nothing, a token stands if it is what its own text gives
                    ok = fits[before, token] = split(before + token, out_type=str, num_threads=1) == ([before, token] if before else [token])
                if ok:
                    last.append(token)
                    count.append(count[i - n] + 1)
                    break
            else:
                raise AssertionError(f"no token ends {s[:i]!r}")
        return np.diff(np.array(count, np.int32))


def _packed(changes: np.ndarray) -> bytes:
    """One signed byte for each code point, or four where one is not enough."""
    small = changes.astype(np.int8)
    return small.tobytes() if np.array_equal(small, changes) else changes.astype("<i4").tobytes()


def unpacked(table: bytes, n_chars: int) -> np.ndarray:
    """Counts at all prefixes, the empty one first."""
    changes = np.frombuffer(table, np.int8 if len(table) == n_chars else "<i4")
    return np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])


def _within(counts: np.ndarray, budget: int) -> int:
    """The longest prefix whose count, without the empty prefix's 0 before it, is at most the budget."""
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def _count(path: str, budgets: tuple[int, ...], keep: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(PrefixCounts, path)
        for batch in batches:
            for i, j in _runs(batch.column("_text")):
                part = batch.slice(i, j - i)
                texts = led_by_space(part.column("_text"))
                if pc.any(pc.match_substring(texts, SPACE)).as_py():
                    texts = pc.replace_substring(texts, SPACE, " ")
                changes, bounds = counter.flat(*bytes_and_offsets(texts))
                n_chars, n_tokens, tables, fits = [], [], [], [[] for _ in budgets]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = changes[a + 1 : b].copy()
                    if b > a:  # the space before the text comes with its first character
                        own[0] += changes[a]
                    counts = np.cumsum(own, dtype=np.int64)
                    n_chars.append(len(own))
                    n_tokens.append(int(counts[-1]) if len(own) else 0)
                    for k, budget in enumerate(budgets):
                        # no prefix has more tokens than bytes: only long texts are looked through
                        fits[k].append(len(own) if n_tokens[-1] <= budget else _within(counts, budget))
                    if keep:
                        tables.append(_packed(own))
                arrays = [part.column("_id"), part.column("_bytes"), pa.array(n_chars, pa.int64()), pa.array(n_tokens, pa.int64())] + [pa.array(f, pa.int64()) for f in fits]
                names = ["_id", "_bytes", "n_chars", "n_tokens", *[f"chars_in_{b}" for b in budgets]]
                if keep:
                    arrays, names = arrays + [pa.array(tables, pa.binary())], names + ["prefix_table"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return of


def prefix_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = (), table: bool = True) -> DataFrame:
    """(id, n_bytes, n_chars, n_tokens, chars_in_<budget> for each budget, prefix_table) of every row's whole text.

    No shuffle: a row's table needs the row alone. A worker holds the parts it knows, at most about 2^20 of them.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _bytes long, n_chars long, n_tokens long" + "".join(f", chars_in_{b} long" for b in budgets) + (", prefix_table binary" if table else "")
    out = rows.mapInArrow(_count(model_path, tuple(budgets), table), schema)
    return out.withColumnsRenamed({"_id": id_col, "_bytes": "n_bytes"})


def tokens_at(table: Column, n_chars: Column, at: Column) -> Column:
    """Tokens of the first ``at`` characters (all of them beyond the end, none below one), from a table."""

    @F.arrow_udf("long")
    def count(tables: pa.Array, sizes: pa.Array, places: pa.Array) -> pa.Array:
        rows = zip(tables.to_pylist(), sizes.to_pylist(), places.to_pylist())
        return pa.array([None if t is None or p is None else int(unpacked(t, n)[min(max(p, 0), n)]) for t, n, p in rows], pa.int64())

    return count(table, n_chars, at)


def chars_within(table: Column, n_chars: Column, budget: Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from a table."""

    @F.arrow_udf("long")
    def longest(tables: pa.Array, sizes: pa.Array, budgets: pa.Array) -> pa.Array:
        rows = zip(tables.to_pylist(), sizes.to_pylist(), budgets.to_pylist())
        return pa.array([None if t is None or b is None else _within(unpacked(t, n)[1:], b) for t, n, b in rows], pa.int64())

    return longest(table, n_chars, budget)
