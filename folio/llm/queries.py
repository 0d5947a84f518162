"""One query per operator of this subpackage, over whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.alignment import align
from folio.llm.common import read
from folio.llm.decontamination import find_contamination
from folio.llm.html_text import html_text
from folio.llm.line_dedup import line_dedup
from folio.llm.mixing import mix
from folio.llm.ngram_jaccard import ngram_jaccard
from folio.llm.prefix_counts import prefix_counts
from folio.llm.quality_rules import quality_rules
from folio.llm.snapshot_diff import snapshot_diff
from folio.llm.substring_dedup import substring_dedup
from folio.llm.token_ids import read_token_ids, write_token_ids
from folio.llm.toxicity import bounded_labels, score, train
from folio.llm.warc import read_warc, write_warc


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in names])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = bounded_labels(read(spark, sf_dir, "labels").where(fold != 2))
    # of the rows for learning those with remainder 3 are for the logistic function
    few = labels.count() <= 1 << 20  # of 12 bytes; more are joined by a shuffle
    trained = train(docs.join(F.broadcast(labels) if few else labels, "doc_id").withColumn("fold", fold), calibrate=F.col("fold") == 3)
    out = score(docs, trained)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_warc(spark, write_warc(read(spark, sf_dir, "pages"), least=100))
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1)
    whole = F.col("record_type") == "response"
    return records.select(
        number("record_id").try_cast("long").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_extract("payload_digest", "sha256:([0-9a-f]+)", 1)).alias("payload_digest"),
        "record_type",
        F.when(~whole, number("refers_to").try_cast("long")).alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d, n >= 100) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS s FROM d)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, s + i AS p FROM (SELECT doc_id, s, unnest(range(0, 35)) AS i FROM win JOIN dup USING (h))),
pos AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM pos ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_ids(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return read_token_ids(files, digests=True)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=13)
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrase AS (SELECT item, least(len(w), 13) AS k, md5(array_to_string(w[s:s + least(len(w), 13) - 1], ' ')) AS h
           FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM phrase),
hit AS (SELECT doc_id, s, k, item FROM (
          SELECT doc_id, s, k, md5(array_to_string(w[s:s + k - 1], ' ')) AS h
          FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS s FROM d, lens)) JOIN phrase USING (k, h)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS signs,
                  md5(CASE WHEN doc_id IS NULL THEN '' ELSE CAST(doc_id AS VARCHAR) || '|' END || coalesce(text, '')) AS h FROM documents),
k AS (SELECT doc_id, source, size, h, CASE WHEN size > 0 THEN -ln((CAST(('0x' || h[1:13]) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (size::DOUBLE / (size + signs)) END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt FROM s),
l AS (SELECT source, n, wt, n / wt::DOUBLE AS r,
             (sum(n) OVER () - 3 * coalesce(sum(n) OVER (ORDER BY n / wt::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(wt) OVER (ORDER BY n / wt::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
f AS (SELECT arg_min(level, r) AS level FROM l WHERE 3 * n > level * wt),
t AS (SELECT l.source, n, CASE WHEN 3 * n <= l.level * wt THEN (3 * n)::DOUBLE ELSE f.level * wt END AS target FROM l LEFT JOIN f ON true),
e AS (SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS epochs, target - CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END * n AS rest FROM t),
o AS (SELECT k.*, e.n, e.target, e.epochs, e.rest, sum(size) OVER (PARTITION BY k.source ORDER BY key NULLS LAST, h ROWS UNBOUNDED PRECEDING) AS run FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target, CAST(CASE WHEN size > 0 THEN (epochs + CASE WHEN 2 * run - size <= 2 * rest THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken FROM o
"""


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def later_snapshot(docs: DataFrame) -> DataFrame:
    """Documents as a later snapshot has them; a document without an id stays."""
    change = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16, F.lit(15))
    rows = docs.where(change != 0).withColumn("again", F.explode(F.when(change == 5, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    new_key = change.isin(3, 4) | F.col("again")
    return rows.select(
        F.when(new_key, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(change == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(change == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(change == 2, F.col("lang")).when(change != 4, F.col("source")).alias("source"),
    )


def op12_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return snapshot_diff(docs, later_snapshot(docs), "doc_id", ["text", "lang", "source"])


OP12_SQL = r"""
WITH poly AS (SELECT [list_reduce([n::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) FOR n IN range(256)] AS t),
d AS (SELECT doc_id AS k, text, lang, source,
             coalesce(xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 16, 15) AS m
      FROM documents, poly),
later AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - k ELSE k END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
                 CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM d WHERE m <> 0
          UNION ALL SELECT -1 - k, text, lang, source FROM d WHERE m = 5),
e AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY k ORDER BY sha256(text) NULLS FIRST, sha256(lang) NULLS FIRST, sha256(source) NULLS FIRST) AS i FROM d),
l AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY k ORDER BY sha256(text) NULLS FIRST, sha256(lang) NULLS FIRST, sha256(source) NULLS FIRST) AS i FROM later),
p AS (SELECT e.r AS er, l.r AS lr FROM e JOIN l ON e.k IS NOT DISTINCT FROM l.k AND e.i = l.i),
ee AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k NULLS FIRST, sha256(lang) NULLS FIRST, sha256(source) NULLS FIRST) AS j FROM e WHERE r NOT IN (SELECT er FROM p)),
ll AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k NULLS FIRST, sha256(lang) NULLS FIRST, sha256(source) NULLS FIRST) AS j FROM l WHERE r NOT IN (SELECT lr FROM p)),
q AS (SELECT ee.r AS er, ll.r AS lr FROM ee FULL JOIN ll ON ee.text IS NOT DISTINCT FROM ll.text AND ee.j = ll.j),
u AS (SELECT er, lr, true AS met FROM p UNION ALL SELECT er, lr, false FROM q),
x AS (SELECT u.*, e.k AS ek, l.k AS lk, l.text AS lt, l.lang AS ll, l.source AS ls,
             CASE WHEN er IS NULL OR lr IS NULL THEN '' ELSE concat_ws(',', CASE WHEN e.text IS DISTINCT FROM l.text THEN 'text' END, CASE WHEN e.lang IS DISTINCT FROM l.lang THEN 'lang' END, CASE WHEN e.source IS DISTINCT FROM l.source THEN 'source' END) END AS changed
      FROM u LEFT JOIN e ON e.r = u.er LEFT JOIN l ON l.r = u.lr)
SELECT CASE WHEN lr IS NULL THEN ek ELSE lk END AS key, ek AS old_key,
       CASE WHEN er IS NULL THEN 'insert' WHEN lr IS NULL THEN 'delete' WHEN NOT met THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed,
       CASE WHEN lr IS NOT NULL THEN sha256(coalesce(lt, '~') || chr(10) || coalesce(ll, '~') || chr(10) || coalesce(ls, '~')) END AS row_sha256 FROM x
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = 4096
    out = prefix_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), budgets=(limit,), table=False)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col(f"chars_in_{limit}").alias("n_chars_within"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_source_mixing": op4_source_mixing,
    "op5_html_extraction": op5_html_extraction,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_ids": op9_token_ids,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_snapshot_diff": op12_snapshot_diff,
    "op13_token_counts": op13_token_counts,
}

ORACLES = {
    "op3_warc": OP3_SQL,
    "op4_source_mixing": OP4_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op12_snapshot_diff": OP12_SQL,
}
