"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import collections
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import fm_index, toxicity, warc
from folio.llm.common import PLAIN, Words, components, sliding_argmin, strings
from folio.llm.decontamination import find_contamination
from folio.llm.html_text import extract, html_text
from folio.llm.line_dedup import banded_distance, edit_links, line_dedup
from folio.llm.mixing import mix
from folio.llm.ngram_jaccard import ngram_jaccard
from folio.llm.quality_rules import quality_rules
from folio.llm.queries import tokenizer_path
from folio.llm.substring_dedup import substring_dedup
from folio.llm.token_ids import crc32, from_planes, read_token_ids, to_planes, write_token_ids
from folio.llm.toxicity import bounded_labels, score, train

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, size string, _q int, gram int"


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out, passage = [], text(40)
    for i in range(60):
        t = text(rng.choice([1, 2, 3, 8, 12, 30, 80, 150]))
        if i % 5 == 0:
            t = f"{t}\n{passage}\n{t[:50]}"
        out.append(t)
    for k in range(40):  # near copies, and copies of copies
        w = out[rng.randrange(len(out))].split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [None, "", "   ", "\n\n", "Hello WORLD hello", text(4000), out[3], out[3], "a " * 100, "x\ty\x0bz"]
    made = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None][i % 4], 5, "z", 1, 2) for i, t in enumerate(out)]
    return [*made, made[3], (None, out[5], None, None, None, None, None, None), (None, None, "en", "s1", 1, "1", 1, 1)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words():
    texts = [None, "", " a b  c", "\x00 \x01a\xa0b", "é ü\n\tz", "a" * 500, "b"]
    for step in (3, 50, 1 << 20):
        data, offsets = strings(pa.array(texts))
        w = Words(data, offsets, PLAIN, step)
        for i, t in enumerate(texts):
            assert [bytes(w.data[w.start[k] : w.end[k]]) for k in range(w.at[i], w.at[i + 1])] == words(t)


def test_sliding_argmin():
    v = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64) << np.uint64(40)
    assert sliding_argmin(v, 7).tolist() == [int(np.argmin(v[i : i + 7])) + i for i in range(194)]


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 9), (3, 1), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 1, 4: 1, 3: 1, 1: 1, 9: 8, 8: 8, **{k: 20 for k in range(20, 25)}}


def test_quality(docs, none, rows):
    got = quality_rules(docs, least=5)
    assert set(got.columns) == set(docs.columns)
    found = [(r.doc_id, r.text, r._q) for r in got.collect()]
    assert len(found) == len(rows)
    for _, t, q in found:
        w = words(t)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (q.n_words, q.n_dup_lines, q.n_repeat_words) == (len(w), len(lines) - len(set(lines)), len(covered))
        assert q.word_chars == sum(len(x.decode()) for x in w)
        assert q.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (not q.base_failed or not q.kept)
    assert quality_rules(none).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    plain, bad = [f"w{k}" for k in range(200)], ["grubl", "snork"]
    data = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            w[5], w[40] = rng.choice(bad), rng.choice(bad)
        data.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data[:400]] + [(0, None), (99999, 1)], "doc_id long, toxic int")
    trained = train(docs.join(bounded_labels(labels), "doc_id"))
    got = {r.doc_id: r.score for r in score(docs, trained).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in data[400:]]) > 0.95
    assert {r.score for r in score(docs, train(docs.join(labels.where("toxic = 5"), "doc_id"))).collect()} == {0.0}


def test_toxic_pairs(spark):
    """Words that are ordinary one by one: only their order tells."""
    rng = random.Random(12)
    plain, texts = [f"w{k}" for k in range(60)], []
    for i in range(800):
        w = [rng.choice(plain) for _ in range(40)]
        w[5:7], w[20:22] = (["red", "fox"], ["red", "fox"]) if i % 4 == 0 else (["fox", "red"], ["fox", "red"])
        texts.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in score(docs, train(docs.where("doc_id < 500"))).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in texts[500:]]) > 0.95


def test_toxic_counts_have_no_cap(spark):
    """All labels and all labelled texts are counted, whatever the logistic function is fitted on."""
    labels = spark.range(450_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    assert bounded_labels(labels).count() == 450_000
    rows = spark.createDataFrame([(f"common word{i} word{i}", i % 2, i % 3 == 0) for i in range(300)], "text string, toxic int, own boolean")
    model, _ = train(rows, calibrate=F.col("own"), max_words=100)
    assert len(model.word) == 201


def test_toxic_head_changes_no_score(spark, monkeypatch):
    """Ratios that are joined, all or some, give what those at hand give; so do keys that many texts ask for."""
    rng = random.Random(31)
    texts = [(i, " ".join(rng.choice("abcdefghij") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randrange(0, 120))), int(i % 3 == 0)) for i in range(300)]
    texts += [(900, None, 1), (901, "", 0), (902, "zz unknown words only", 0), (None, texts[0][1], None), (902, "zz again", None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int").repartition(3)
    rows = docs.where("doc_id < 200")
    scores = lambda trained: sorted((str(r.doc_id), round(r.score, 6)) for r in score(docs, trained).collect())
    whole = train(rows)
    assert whole[0].bits is None and whole[0].rest.isEmpty()
    exp = scores(whole)
    assert len(exp) == len(texts) and len({s for _, s in exp}) > 100
    for head in (40, 0):
        some = train(rows, head=head)
        assert len(some[0].word) <= head and some[0].bits is not None
        assert scores(some) == exp
    monkeypatch.setattr(toxicity, "_OFTEN", 20)
    assert scores(some) == exp


def test_warc(spark):
    long = "<p>" + "ä" * 120
    pages = [(1, "http://a/1", long), (2, "http://a/\n2", long), (3, None, None), (4, "u", "short"), (5, "v", "short"), (0, "w", long), (None, "n", "<b>x"), (6, "r", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for packed in (False, True):
        folder = warc.write_warc(df, split=300, packed=packed)
        got = {r.record_id: r for r in warc.read_warc(spark, folder).collect()}
        assert len(got) == len(pages)
        assert {k: got[f"urn:page:{k}".join("<>")].refers_to for k in range(7)} == {0: None, 1: "<urn:page:0>", 2: "<urn:page:0>", **{k: None for k in range(3, 7)}}
        assert bytes(got["<urn:page:0>"].payload).decode() == long and got["<urn:page:1>"].payload is None and got["<urn:page:1>"].http_length == len(long.encode())
        some = warc.read_warc(spark, folder).where("record_type = 'revisit'")
        assert some.count() == 2 and warc.read_warc(spark, folder, payload=False).where("payload is not null").count() == 0
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def test_warc_pushes_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    r = warc.WarcReader({"path": "x"})
    assert [type(f) for f in r.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("offset",), 3)])] == [GreaterThan]
    assert r._wanted({"record_type": "response"}) and not r._wanted({"record_type": "revisit"})


def test_mix(docs, none, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows) and mix(none).count() == 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    size = {s: sum(r.size for r in by[s]) for s in order}
    weight, target, left, open_ = dict(zip(order, [5, 2, 1])), {}, sum(size.values()), set(order)
    while open_:  # reshare until none is above
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * size[s]}
        for s in over or open_:
            target[s] = 3 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s in order:
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and r.taken <= 3 * r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r.size for r in by[s])
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, got))


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><li>m</nav><div class='side-bar sidebar'>no</div><article><h1>Head</h1><p>One &amp; <b>t</b>wo&nbsp; x<p>Three<br>four<form>f</form></article><div id=comments><p>c</div><footer>f"
    df = spark.createDataFrame([(1, page, "old"), (2, None, None), (3, "", ""), (4, "just text", "")], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in html_text(df).collect()} == {1: "Head One & two x Three four", 2: "", 3: "", 4: "just text"}
    assert extract("<p>" + "long text " * 2000) == ("long text " * 2000).strip()


@pytest.mark.parametrize("frame", ["article", "main", "div"])
def test_html_of_uneven_sections(frame):
    """A section of long paragraphs, one of short ones and the headings are kept, a list of links beside them is not."""
    long, short = [[f"{k} " + "text " * n for k in range(m)] for m, n in ((10, 160), (20, 16))]
    section = lambda head, rows: f"<section><h2>{head}</h2>" + "".join(f"<p>{x}</p>" for x in rows) + "</section>"
    links = "<div>" + "".join(f"<p><a href='/{k}'>Go {k}</a></p>" for k in range(9)) + "</div>"
    page = f"<body>{links}<{frame}><h1>Head</h1>{section('A', long)}{section('B', short)}<p><a href='/s'>Source</a></p></{frame}><p>Outside</p></body>"
    assert extract(page) == " ".join(" ".join(x.split()) for x in ["Head", "A", *long, "B", *short, "Source", "Outside"])


@pytest.mark.parametrize("n, num", [(3, 90), (2, 80), (5, 80)])
def test_jaccard(docs, none, rows, n, num):
    got = ngram_jaccard(docs, n=n, num=num).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t, *_ in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root = {i: i for i in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(root), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= num * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) if r.doc_id is not None else r.component_id is None
        if r.doc_id is not None:
            assert r.component_id == find(r.doc_id)
    if n == 3:
        assert ngram_jaccard(none).count() == 0


def test_jaccard_of_a_large_group(spark):
    """Many near copies of one text, most of them too far from each other; some links only among strays."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(150):
        w = list(texts[-1].split()) if i % 4 == 3 else list(base)
        for _ in range(rng.randint(0, 5) if i % 4 != 3 else 1):
            w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    label = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        if 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    assert {r.doc_id: r.component_id for r in ngram_jaccard(docs, n=3, num=90).collect()} == dict(enumerate(label))


def test_substring(docs, none, rows):
    got = substring_dedup(docs, length=12, seed=5).collect()
    assert len(got) == len(rows) and substring_dedup(none).count() == 0
    count = collections.Counter(tuple(w[s : s + 12]) for _, t, *_ in rows for w in [words(t)] for s in range(len(w) - 11))
    exp = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = {k for s in range(len(w) - 11) if count[tuple(w[s : s + 12])] > 1 for k in range(s, s + 12)}
        exp[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == exp


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
    df = spark.createDataFrame([(word(), word()) for _ in range(200)], "a string, b string")
    for r in df.select("a", "b", banded_distance(F.col("a"), F.col("b"), 2).alias("d")).collect():
        assert min(r.d, 3) == min(distance(r.a, r.b), 3)


def test_lines(spark, none):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8)) for _ in range(30)]
    for t in list(texts):
        w = list(t)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        texts.append("".join(w)[rng.randint(0, 1) :])
    exp = {(a, b) for a, b in combinations(range(len(texts)), 2) if distance(texts[a], texts[b]) <= 2}
    got = {tuple(sorted((r.a, r.b))) for r in edit_links(spark.createDataFrame(list(enumerate(texts)), "node long, line string"), 2).collect()}
    assert got == exp and got
    rows = [(1, texts[0] + "\n\nshort\n" + texts[1], 1), (2, texts[0][:-1] + "\nshort\nother", 2), (3, None, 3), (4, "", 4), (None, "short", 5)]
    out = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()}
    first = out.pop(None)
    assert first == (1, 0, "short") and out == {1: (3, 1, texts[0] + "\n\n" + texts[1]), 2: (3, 2, "other"), 3: (0, 0, ""), 4: (0, 0, "")}
    assert line_dedup(none).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_short_lines(spark, edits):
    rng = random.Random(8)
    lines = sorted({"".join(rng.choice("abcdé.7") for _ in range(rng.choice([1, 2, 3, 3, 4, 4, 5, 6, 8, 11, 39]))) for _ in range(160)} | {"Click here", "Click here.", "Share (1)", "Share (2)", "x" * 39, "x" * 40})
    near = {(a, b) for a, b in combinations(range(len(lines)), 2) if distance(lines[a], lines[b]) <= edits}
    tiny = {(a, b) for a, b in near if max(len(lines[a]), len(lines[b])) <= edits}
    got = [tuple(sorted((r.a, r.b))) for r in edit_links(spark.createDataFrame(list(enumerate(lines)), "node long, line string"), edits).collect()]
    assert len(got) == len(set(got)) and set(got) - tiny == near - tiny
    assert {pair for pair in got if pair in tiny} == {pair for pair in tiny if pair[0] == min(tiny)[0]}
    texts = ["Menu 1\nClick here\nfirst", "Menu 2\nClick here.\nsecond", "Share\nClick hére\n??\na"]
    out = line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), edits=edits).orderBy("doc_id").collect()
    assert [r.kept_text for r in out] == [texts[0], "second", "Share\n??" + "\na" * (edits == 1)]


def test_repeated_lines_link_once(spark):
    """Lines needn't be distinct (no shuffle of all of them): links are those of distinct ones, and a line of wider characters meets one of single bytes."""
    lines = ["a", "é", "abc", "abé", "the long line of words that ends here", "the long line of words that ends héré", "the löng line of words that ends here", "x" * 64 + "e", "x" * 64, "x" * 61 + "é"]
    near = {(a, b) for a, b in combinations(range(len(lines)), 2) if distance(lines[a], lines[b]) <= 2}
    got = [tuple(sorted((r.a, r.b))) for r in edit_links(spark.createDataFrame(list(enumerate(lines)) * 3, "node long, line string"), 2).collect()]
    assert len(got) == len(set(got)) and set(got) == near and (4, 5) in near and (5, 6) not in near


def test_planes():
    ids = np.random.default_rng(0).integers(0, 1 << 32, 77, dtype=np.uint64).astype("<u4")
    for bits in (False, True):
        assert (from_planes(to_planes(ids, bits), 77) == ids).all()


def test_token_ids(docs, none, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    for bits in (False, True):
        got = read_token_ids(write_token_ids(docs, tokenizer_path(), chunk=100, bits=bits)).withColumn("crc", crc32("ids")).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
        at, exp = 0, collections.Counter()
        for r in got:
            assert r.start == at
            at += r.n_tokens
        for i, t, *_ in rows:
            ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            exp[i, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert collections.Counter((r.doc_id, r.n_tokens, r.crc) for r in got) == exp
    assert read_token_ids(write_token_ids(none, tokenizer_path())).count() == 0


def test_fm_index():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 4, 300)
    index = fm_index.FMIndex(codes, 3, sample=5)
    for k in (1, 2, 4):
        patterns = rng.integers(1, 4, (20, k))
        found, place = index.search(patterns)
        exp = {(p, s) for p in range(20) for s in range(300 - k + 1) if (codes[s : s + k] == patterns[p]).all()}
        assert set(zip(found.tolist(), place.tolist())) == exp and len(found) == len(exp)


@pytest.mark.parametrize("block", [1 << 18, 1])
def test_decontamination(spark, docs, none, rows, block):
    long = max((t for _, t, *_ in rows if t), key=len).split()
    items = [(1, " ".join(long[100:130])), (2, "hello world"), (10, rows[2][1]), (3, None), (4, " . "), (None, "x"), (11, " ".join(long[110:118]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tokens = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for s in range(max(len(w) - 12, 1) if w else 0):
            phrases[tuple(w[s : s + 13])].add(None if i is None else str(i))
    got = find_contamination(docs, bench, window=13, shard=200, block=block).collect()
    assert len(got) == len(rows)
    exp = collections.Counter()
    for i, t, *_ in rows:
        w, hit, names = tokens(t), set(), set()
        for k in {len(p) for p in phrases}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in phrases:
                    hit |= set(range(s, s + k))
                    names |= phrases[tuple(w[s : s + k])]
        exp[i, len(w), len(hit), len(names), ",".join(sorted(names - {None})), bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), ",".join(x for x in r["items"] if x is not None), r.contaminated) for r in got) == exp
    unnamed = spark.createDataFrame([(None, "alpha beta gamma")], "item_id long, text string")
    r = find_contamination(spark.createDataFrame([(1, "x alpha beta gamma y")], "doc_id long, text string"), unnamed).first()
    assert (r.n_hit, r["items"], r.contaminated) == (3, [None], True)
    assert find_contamination(none, bench).count() == 0 and find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
        assert name == "source_mixing" or docs.count() <= n
        n = docs.count()
    out = P.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == n and n
