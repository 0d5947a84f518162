"""Queries over the whole smallest tables, with production parameters, against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folio.llm import queries
from folio.llm.common import ALNUM, Words, strings
from folio.llm.quality_rules import RULES, STEADY
from folio.llm.toxicity import train

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def quantile(values, p):
    """The least value with a share of p at or below it."""
    values = sorted(values)
    return values[max(0, math.ceil(p * len(values) - 1e-12) - 1)]


def quality(docs):
    out = []
    for d in docs:
        text = d["text"] or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        at = collections.defaultdict(list)
        for s in range(len(w) - 4):
            at[tuple(w[s : s + 5])].append(s)
        again = {s + k for places in at.values() if len(places) > 1 for s in places for k in range(5)}
        n = len(w)
        r = {"doc_id": d["doc_id"], "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again)}
        r["base_failed"] = n < 10 or 100 * len(again) > 20 * n
        ratio = {"symbol_ratio": r["n_symbols"] / n, "word_length": r["word_chars"] / n} if n else {}
        if lines:
            ratio["dup_line_ratio"] = r["n_dup_lines"] / len(lines)
        out.append((r, ratio, d["lang"], d["source"]))
    groups, langs = collections.defaultdict(list), collections.defaultdict(list)
    for r, ratio, lang, source in out:
        if r["n_words"]:
            groups[lang, source].append(ratio)
            langs[lang].append(ratio)
    for r, ratio, lang, source in out:
        own = groups[lang, source] if len(groups[lang, source]) >= 50 else langs[lang]
        kept = not r["base_failed"]
        for name, (side, spreads, smallest) in RULES.items():
            values = [x[name] for x in own if name in x]
            if kept and name in ratio and values:
                low, mid, high = (quantile(values, p) for p in (0.25, 0.5, 0.75))
                x = mid + (ratio[name] - mid) / math.sqrt(max(1.0, STEADY / r["n_words"]))
                kept = x <= mid + spreads * max(high - mid, smallest) and (side != "both" or x >= mid - spreads * max(mid - low, smallest))
        r["kept"] = kept
    return [r for r, _, _, _ in out]


def test_quality_rules(spark, documents):
    got = [r.asDict() for r in queries.op1_quality_rules(spark, SF).collect()]
    exp = quality(documents)
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(exp, key=key)
    assert any(not r["kept"] and not r["base_failed"] for r in exp) and any(r["n_symbols"] for r in exp)


def within(a, b, edits):
    """Whether two lines are within so many edits, by the table of distances near its diagonal."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = {j: j for j in range(min(len(b), edits) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            best = row.get(j, 99) + 1
            if j:
                best = min(best, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (a[i - 1] != b[j - 1]))
            else:
                best = min(best, i)
            new[j] = best
        if min(new.values()) > edits:
            return False
        row = new
    return row[len(b)] <= edits


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_line_dedup(spark, documents):
    docs = sorted(documents, key=lambda d: d["doc_id"])
    lines, groups = sorted({x for d in docs for x in (d["text"] or "").split("\n") if re.search(r"\S", x)}, key=len), Groups()
    count = [np.array([x.count(c) for c in "etaoinshrdlu .,"]) for x in lines]
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            if len(lines[j]) - len(a) > 2:
                break
            if np.abs(count[i] - count[j]).sum() <= 4 and within(a, lines[j], 2):
                groups.join(a, lines[j])
    seen, exp = set(), {}
    for d in docs:
        kept, gone, n = [], 0, 0
        for x in (d["text"] or "").split("\n"):
            if re.search(r"\S", x):
                n += 1
                if groups.find(x) in seen:
                    gone += 1
                    continue
                seen.add(groups.find(x))
            kept.append(x)
        exp[d["doc_id"]] = (n, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op8_line_dedup(spark, SF).collect()}
    assert got == exp and any(g for _, g, _ in exp.values())


def near_copies(docs):
    """Of each group of 5-word shingles' similarity 0.8 the document with the smallest id."""
    sets, groups = {}, Groups()
    for d in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return [d for d in docs if groups.find(d["doc_id"]) == d["doc_id"]]


def clean(docs, benchmark):
    """Documents of which less than one word in 20 is in a benchmark phrase."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = collections.defaultdict(set)
    for b in benchmark:
        w = words(b["text"])
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            phrases[k].add(tuple(w[s : s + k]))
    out = []
    for d in docs:
        w = words(d["text"])
        hit = {s + i for k, some in phrases.items() for s in range(len(w) - k + 1) if tuple(w[s : s + k]) in some for i in range(k)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(d)
    return out


def test_pipeline_end_to_end(spark, documents):
    kept = {r["doc_id"] for r in quality(documents) if r["kept"]}
    docs = near_copies([d for d in documents if d["doc_id"] in kept])
    rest = clean(docs, pq.read_table(f"{SF}/benchmark.parquet").to_pylist())
    assert len(documents) > len(kept) > len(docs) > len(rest) > 0
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(rest))
    text, copies = {d["doc_id"]: d["text"] or "" for d in rest}, {}
    for r in con.execute(queries.OP4_SQL).to_arrow_table().to_pylist():
        copies[r["doc_id"]] = r["taken"] // r["size"] if r["size"] else 0
    model, exp, start = Tokenizer.from_file(queries.tokenizer_path()), [], 0
    for i in sorted(copies):
        ids = np.array([*model.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
        for _ in range(copies[i]):
            exp.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(exp)


STAGE_ROWS = [(1, "a b c d e f g h i j k l m", "en", "s"), (1, "a b c d e f g h i j k l m", "en", "s"), (2, None, None, None), (None, "", "en", None), (None, "one two three four five six seven eight nine ten eleven", None, "s"), (3, "x", "en", "s")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_nulls_repeated_rows_and_no_rows(spark, name, stage):
    docs = spark.createDataFrame(STAGE_ROWS, "doc_id long, text string, lang string, source string")
    assert stage(spark, docs.where("false"), SF).count() == 0
    got = [r.doc_id for r in stage(spark, docs, SF).collect()]
    assert set(got) <= {1, 2, 3, None}
    if name == "ngram_jaccard":
        assert sorted(map(str, got)) == ["1", "2", "3", "None", "None"]
    if name in ("benchmark_decontamination", "token_ids"):
        assert len(got) == 6


CLASHING = ["text_key", "copy", "copies", "again_id", "again_key", "taken_id", "taken_key", "gone_id", "gone_key", "_q", "_c", "_cut", "_id", "_key", "row", "size", "key", "target"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, name, stage):
    plain = spark.createDataFrame(STAGE_ROWS + [(9, " ".join(f"word{k}" for k in range(60)), "en", "s")], "doc_id long, text string, lang string, source string")
    more = plain.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    got = stage(spark, more, SF)
    assert got.columns == more.columns
    rows = got.collect()
    assert sorted(map(str, (tuple(r)[:4] for r in rows))) == sorted(map(str, (tuple(r) for r in stage(spark, plain, SF).collect())))
    assert all(set(tuple(r)[4:]) == {7} for r in rows) and rows


def test_toxic_model_by_plain_counts(spark):
    texts = [("a b a c", 1), ("a b d", 1), ("a b", 1), ("c d e a b", 0), ("e e c d", 0), ("e c d f", 0), ("c d", 0)]
    rows = spark.createDataFrame([(t, y, False) for t, y in texts] + [("a b", 1, True), ("c d", 0, True)], "text string, toxic int, own boolean")
    model, _ = train(rows, calibrate=F.col("own"))
    words = [(t.split(), y) for t, y in texts]
    one = [collections.Counter(w for t, y in words if y == c for w in t) for c in (1, 0)]
    two = [collections.Counter(p for t, y in words if y == c for p in zip(t, t[1:])) for c in (1, 0)]
    seen1, seen2 = one[0] + one[1], two[0] + two[1]
    before = collections.Counter(b for _, b in seen2)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(1, 5)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        return [0.0] + [min(float(k), max(0.1, k - (k + 1) * y * n[k] / max(1, n[k - 1]))) for k in (1, 2, 3)]

    def share(c, w):
        """Of a class, the probability of a word; None: any unknown one."""
        d, total = discounts(one[c].values()), sum(one[c].values())
        kept = {x: one[c][x] - d[min(one[c][x], 3)] for x in seen1 if seen1[x] > 1}
        known = w is not None and seen1[w] > 1
        back = (max(before[w], 0.5) if known else 0.5) / sum(before.values())
        return (kept.get(w, 0) + (total - sum(kept.values())) * back) / total

    def after(c, v, w):
        d, n = discounts(two[c].values()), sum(k for (a, _), k in two[c].items() if a == v)
        if not n:
            return share(c, w)
        kept = {p: two[c][p] - d[min(two[c][p], 3)] for p in seen2 if p[0] == v and seen2[p] > 1}
        return (kept.get((v, w), 0) + max(n - sum(kept.values()), 1e-3) * share(c, w)) / n

    data, offsets = strings(pa.array(["a b c d e f g"]))
    hashes = Words(data, offsets, ALNUM).hash
    exp = [math.log(share(0, w) / share(1, w)) for w in "abcdefg"]
    assert np.allclose(model.of(hashes), exp, atol=1e-5)
    pairs = model.of_pairs(hashes, np.array([True] + [False] * 6), model.of(hashes))
    assert np.allclose(pairs[1:5], [math.log(after(0, v, w) / after(1, v, w)) for v, w in zip("abcd", "bcde")], atol=1e-4)
    assert len(model.pair) == sum(n > 1 for n in seen2.values()) and set("fg") - set(seen1) == {"g"}
