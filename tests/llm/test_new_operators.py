"""Alignment, snapshot difference and prefix counts against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from folio.llm import queries
from folio.llm.alignment import align
from folio.llm.pieces import byte_level_signs
from folio.llm.prefix_counts import chars_within, prefix_counts, tokens_at
from folio.llm.snapshot_diff import snapshot_diff

SF = "/root/testdata/sf0.001"
A_FILE, B_FILE = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
SIGNS = list("aaabcdeeott  \n\n\r\t.,-'\"0123 ▁éß日本語テ𠮷 <s>x\x00")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def odd_texts(n: int, most: int = 80) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, most))) for _ in range(n)]


EDGES = [(1000, None), (1001, ""), (1002, "a<|endoftext|>b</s> <unk>"), (1002, "same id"), (None, "no id"), (2007, "word " * 3000), (2008, "a" * 3000)]


def linked(ids, spell):
    ends, at = [], 0
    for i in ids:
        at += len(spell(i))
        ends.append(at)
    return ends


def brute_alignment(rows, pieces):
    """Tokens from the libraries, groups and links by walking both lists."""
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(A_FILE)
    words.encode_special_tokens = True
    signs = byte_level_signs()
    spelled = {k: bytes(signs[c] for c in t) for t, k in words.get_vocab(with_added_tokens=False).items()}
    of_b = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    told, count = [], Counter()
    for doc, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = words.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            if b"".join(map(of_b, b)) != (" " + text).encode():
                a, b = [], []
        ea, eb = linked(a, spelled.get), linked(b, of_b)
        for i, end in enumerate(ea):
            start = ea[i - 1] if i else 0
            links += [(a[i], b[j]) for j in range(len(b)) if (eb[j - 1] if j else 0) < end and eb[j] > start]
        low = 0
        for cut in sorted(set(ea) & set(eb)):
            inside = lambda ids, ends: ",".join(str(x) for x, e in zip(ids, ends) if low < e <= cut)  # noqa: B023, E731
            groups.append(inside(a, ea) + "|" + inside(b, eb))
            low = cut
        told.append((doc, len(a), len(b), links, groups))
        count.update(links)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(d, na, nb, len(g), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, ls, g in told]


@pytest.mark.parametrize("run_bytes", [200, 1 << 21])
def test_alignment(spark, pieces, run_bytes):
    rows = list(enumerate(odd_texts(150))) + EDGES[:5] + [(1003, "x y"), (1003, "x y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, run string")
    got = align(df, A_FILE, B_FILE, run_bytes=run_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_alignment(rows, pieces), key=str)


def test_alignment_of_nothing(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A_FILE, B_FILE).collect() == []
    assert [tuple(r) for r in align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A_FILE, B_FILE).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_query(spark, pieces):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1] or "") < 4000]
    got = {r.doc_id: tuple(r)[:5] + (r.groups_sha256,) for r in queries.op11_cross_tokenizer_alignment(spark, SF).collect()}
    assert all(got[r[0]] == r[:5] + (r[7],) for r in brute_alignment(rows, pieces))


def test_prefix_counts(spark, pieces):
    rows = list(enumerate(odd_texts(120, 50))) + EDGES
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int")
    table = prefix_counts(df, B_FILE, budgets=(20,))
    got = sorted(map(tuple, table.drop("prefix_table").collect()), key=str)
    count = lambda t: len(pieces.encode(t))
    fits = lambda t, n: max(i for i in range(len(t) + 1) if count(t[:i]) <= n) if len(t) < 100 else None
    want = sorted(((d, len((t or "").encode()), len(t or ""), count(t or ""), fits(t or "", 20)) for d, t in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(w[4] is None or g[4] == w[4] for g, w in zip(got, want))
    for at in (0, 1, 7, 23, 1000):
        asked = table.join(df.select("doc_id", "text"), "doc_id").where("length(text) < 100 and doc_id <> 1002").select("text", tokens_at(table.prefix_table, table.n_chars, spark_lit(at)).alias("n"), chars_within(table.prefix_table, table.n_chars, spark_lit(at)).alias("c"))
        for r in asked.collect():
            assert r.n == count(r.text[:at]) and r.c == fits(r.text, at)


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value).cast("long")


def test_token_counts_query(spark, pieces):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_token_counts(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(pieces.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def digest(v):
    return (0, "") if v is None else (1, hashlib.sha256(v.encode()).hexdigest())


def brute_diff(earlier, later, descending):
    out, left, right = [], [], []
    values = lambda x: tuple(map(digest, x[1:]))
    for k in {x[0] for x in earlier + later}:
        a, b = (sorted((x for x in side if x[0] == k), key=values) for side in (earlier, later))
        out += [(x, y, True) for x, y in zip(a, b)]
        left, right = left + a[len(b) :], right + b[len(a) :]
    key = lambda x: (x[0] is not None, 0 if x[0] is None else x[0], *map(digest, x[2:]))
    for t in {x[1] for x in left + right}:
        a, b = sorted((x for x in left if x[1] == t), key=key), sorted((x for x in right if x[1] == t), key=key, reverse=descending)
        out += [(x, y, False) for x, y in zip(a, b)] + [(x, None, False) for x in a[len(b) :]] + [(None, y, False) for y in b[len(a) :]]
    rows = []
    for x, y, met in out:
        changed = ",".join(n for n, p, q in zip(("text", "lang", "source"), x[1:], y[1:]) if p != q) if x and y else ""
        op = "insert" if x is None else "delete" if y is None else "rekey" if not met else "update" if changed else "same"
        rows.append(((y or x)[0], x[0] if x else None, op, changed, hashlib.sha256("\n".join("~" if v is None else v for v in y[1:]).encode()).hexdigest() if y else None))
    return sorted(rows, key=str)


@pytest.mark.parametrize("most", [4, 5000])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [[None, 1, 2, 3, 2**60, 2**60 + 1], [None, "", "a", "b", "é"]])
def test_snapshot_diff(spark, most, descending, keys):
    """Repeated and null keys, null and repeated contents, groups above and below the size of a slice."""
    rng = random.Random(5)
    row = lambda: (rng.choice(keys), rng.choice([None, "", "t", "t", "u", "v"]), rng.choice([None, "a", "b"]), rng.choice([None, "s"]))
    earlier, later = [row() for _ in range(70)], [row() for _ in range(80)]
    kind = "long" if 1 in keys else "string"
    frame = lambda rows: spark.createDataFrame([(*r, 9, 9) for r in rows], f"doc_id {kind}, text string, lang string, source string, bucket int, c0 int")
    got = snapshot_diff(frame(earlier), frame(later), "doc_id", ["text", "lang", "source"], descending, slice_rows=most)
    assert sorted(map(tuple, got.collect()), key=str) == brute_diff(earlier, later, descending)


def test_snapshot_diff_of_nothing(spark):
    none, one = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([], [(1, "x")]))
    ops = lambda a, b: [r.op for r in snapshot_diff(a, b, "doc_id", ["text"]).collect()]
    assert (ops(none, none), ops(one, none), ops(none, one), ops(one, one)) == ([], ["delete"], ["insert"], ["same"])


def test_snapshot_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.OP12_SQL).fetchall(), key=str)
    assert sorted(map(tuple, queries.op12_snapshot_diff(spark, SF).collect()), key=str) == want
    assert {r[2] for r in want} == {"same", "update", "rekey", "insert", "delete"}
