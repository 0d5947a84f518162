"""The engine's queries over the driver's tables, by name, each with the SQL that says the same where SQL can.

documents.text stands for a section of the book named by source, pages.html for a
book's item, conversations for a book's chunks, events for a log of model calls.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio import lexicons as L
from folio.functions import prompts, reply
from folio.functions import text as T
from folio.operators import assemble, memory, mentions, pack, routing, segment, state
from folio.operators.snapshots import StateTable
from folio.plans import pipeline
from folio.session import kept, shared, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# Texts with markers put in, the same way in both engines: by line number, a chapter, a scene break, two blank lines or a name.
MARKED_SQL = r"""
lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
marked AS (SELECT doc_id, source, array_to_string([CASE WHEN i % 7 = 3 THEN 'Chapter ' || i || chr(10) WHEN i % 7 = 5 THEN '***' || chr(10) WHEN i % 11 = 8 THEN chr(10) || chr(10) WHEN i % 13 = 10 THEN '*Mara*' || chr(10) ELSE '' END || l[i + 1] FOR i IN range(len(l))], chr(10)) AS text FROM lines)
"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = lambda i: (
        F.when(i % 7 == 3, F.concat(F.lit("Chapter "), i.cast("string"), F.lit("\n")))
        .when(i % 7 == 5, F.lit("***\n")).when(i % 11 == 8, F.lit("\n\n")).when(i % 13 == 10, F.lit("*Mara*\n")).otherwise(F.lit(""))
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(lead(i), x)), "\n").alias("text"))


TOKENS_SQL = "CAST(floor(len(regexp_extract_all(coalesce({0}, ''), '\\S+')) * 1.3::DOUBLE) AS INTEGER)"


@query(f"SELECT doc_id, source, {TOKENS_SQL.format('text')} AS est FROM documents")
def q_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", T.est_tokens(F.col("text")).alias("est"))


LINES_SQL = MARKED_SQL + r""",
parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM marked),
each AS (SELECT doc_id, source, i AS line_no, CASE WHEN i < len(p) - 1 THEN p[i + 1] || chr(10) ELSE p[i + 1] END AS line FROM (SELECT doc_id, source, p, unnest(range(len(p))) AS i FROM parts)),
lin AS (SELECT doc_id, source, line_no, line, CAST(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
        trim(line, ' ' || chr(10) || chr(9) || chr(13)) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM each WHERE line <> ''),
cls AS (SELECT *, CASE WHEN s = '' AND lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) = '' AND line_no > 0 AND line_no < n - 1 THEN 'scene' WHEN s = '' THEN NULL
        WHEN regexp_matches(s, '(?i)^cap[ií]tulo\s+[\dIVXLC]+') OR regexp_matches(s, '(?i)^chapter\s+[\dIVXLC]+') OR regexp_matches(s, '^#{1,2}\s+.+') OR regexp_matches(s, '(?i)^part\s+[\dIVXLC]+') OR regexp_matches(s, '(?i)^[IVXLC]{1,6}\.$') THEN 'chapter'
        WHEN regexp_matches(s, '^[*\-—]{3,}$') OR regexp_matches(s, '^[*\-—]\s*[*\-—]\s*[*\-—]$') OR regexp_matches(s, '^·{3,}$') OR regexp_matches(s, '^#{3,}$') THEN 'scene'
        WHEN regexp_matches(s, '^\*{1,2}[A-ZÁÉÍÓÚ][^*]+\*{1,2}$') OR regexp_matches(s, '^[A-ZÁÉÍÓÚ]{2,}[^.!?]*$') THEN 'pov' END AS boundary FROM lin)
"""


@query(f"WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, start, length(line) AS n FROM cls")
def q_lines_offsets(spark, sf_dir):
    return segment.lines(marked(spark, sf_dir), "doc_id").select("doc_id", "line_no", "start", F.length("line").cast("long").alias("n"))


@query(f"WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, boundary FROM cls WHERE boundary IS NOT NULL")
def q_line_boundaries(spark, sf_dir):
    return segment.classified(marked(spark, sf_dir), "doc_id").where("boundary is not null").select("doc_id", "line_no", "boundary")


SEGMENTS_SQL = (
    LINES_SQL
    + f""",
isl AS (SELECT *, sum(CASE WHEN boundary IS NOT NULL AND line_no > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM cls),
grp AS (SELECT doc_id, any_value(source) AS source, island, arg_min(coalesce(boundary, 'paragraph'), line_no) AS b, min(start) AS original_position, trim(string_agg(line, '' ORDER BY line_no), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM isl GROUP BY doc_id, island),
seg AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) AS seg_no, b AS boundary_type, original_position, text, {TOKENS_SQL.format('text')} AS token_estimated FROM grp WHERE text <> '')
"""
)


@query(f"WITH {SEGMENTS_SQL} SELECT doc_id, seg_no, boundary_type, original_position, text, token_estimated FROM seg")
def q_segments(spark, sf_dir):
    return segment.segments(marked(spark, sf_dir), "doc_id")


@query(f"WITH {SEGMENTS_SQL} SELECT source, boundary_type, count(*) AS n, sum(token_estimated)::BIGINT AS tokens, max(token_estimated) AS most FROM seg GROUP BY source, boundary_type")
def q_segment_summary(spark, sf_dir):
    rows = segment.segments(marked(spark, sf_dir), "doc_id", "source")
    return rows.groupBy("source", "boundary_type").agg(F.count("*").alias("n"), F.sum("token_estimated").alias("tokens"), F.max("token_estimated").alias("most"))


MARKER_SQL = "(regexp_matches({0}, '(?i)^\\s*(chapter|capítulo|chapitre|kapitel)\\s+[\\divxlc]+') OR regexp_matches({0}, '(?i)^\\s*(chapter|capítulo)\\s+[\\pL\\pN_]+') OR regexp_matches({0}, '(?i)^\\s*[\\divxlc]{{1,6}}[\\.\\-\\)]\\s') OR regexp_matches({0}, '^\\s*\\*{{3,}}\\s*$') OR regexp_matches({0}, '^\\s*-{{3,}}\\s*$') OR regexp_matches({0}, '^\\s*#{{1,3}}\\s+[\\pL\\pN_]'))"


@query(f"""WITH {MARKED_SQL}, p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM marked),
e AS (SELECT doc_id, l[i + 1] AS line, i FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM p)),
m AS (SELECT *, {MARKER_SQL.format('line')} AS mk FROM e),
g AS (SELECT *, sum(CASE WHEN mk AND i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM m
      WHERE doc_id IN (SELECT doc_id FROM m WHERE mk GROUP BY doc_id HAVING count(*) >= 2)),
t AS (SELECT doc_id, island, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10) || chr(9)) AS text FROM g GROUP BY doc_id, island)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) AS section_idx, text FROM t WHERE text <> ''""")  # fmt: skip
def q_section_split(spark, sf_dir):
    return segment.sections(marked(spark, sf_dir).where(segment.has_markers(F.col("text"))), "doc_id")


@query(f"""WITH {MARKED_SQL}, p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM marked),
e AS (SELECT doc_id, unnest(l) AS line FROM p) SELECT doc_id, count(*) FILTER (WHERE {MARKER_SQL.format('line')}) >= 2 AS chapters FROM e GROUP BY doc_id""")
def q_has_markers(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", segment.has_markers(F.col("text")).alias("chapters"))


# Lines as blocks, so that the fixtures, which have no blank lines, exercise the folds.
_BLOCKS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
FOLD_SQL = r"""
WITH RECURSIVE b AS (SELECT doc_id, {parts} AS l FROM documents),
w AS (SELECT doc_id, l, [len(regexp_extract_all(x, '\S+')) FOR x IN l] AS n FROM b WHERE len(l) > 0),
f AS (SELECT doc_id, l, n, 1 AS i, 0 AS g, {first} AS c FROM w UNION ALL SELECT doc_id, l, n, i + 1, {group}, {count} FROM f WHERE i < len(l))
"""


@query(FOLD_SQL.format(parts=_BLOCKS, first="n[1]", group="CASE WHEN c >= 40 THEN g + 1 ELSE g END", count="CASE WHEN c >= 40 THEN n[i + 1] ELSE c + n[i + 1] END") + r""",
k AS (SELECT doc_id, i, g, l[i] AS x, max(g) OVER (PARTITION BY doc_id) AS last, sum(n[i]) OVER (PARTITION BY doc_id, g) AS total FROM f),
m AS (SELECT doc_id, i, CASE WHEN g = last AND total < 40 AND g > 0 THEN g - 1 ELSE g END AS g, x FROM k)
SELECT doc_id, CAST(g AS INTEGER) AS section_idx, string_agg(x, chr(10) || chr(10) ORDER BY i) AS text FROM m GROUP BY doc_id, g""")  # fmt: skip
def q_section_merge40(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id", F.posexplode(segment.paragraph_sections(text)).alias("section_idx", "text"))


_TOK = "CAST(floor(n[{0}] * 1.3::DOUBLE) AS INTEGER)"


@query(FOLD_SQL.format(parts=_BLOCKS, first=_TOK.format(1), group=f"CASE WHEN c + {_TOK.format('i + 1')} > 200 THEN g + 1 ELSE g END", count=f"CASE WHEN c + {_TOK.format('i + 1')} > 200 THEN {_TOK.format('i + 1')} ELSE c + {_TOK.format('i + 1')} END")
       + " SELECT doc_id, CAST(g AS INTEGER) AS piece, string_agg(l[i], chr(10) || chr(10) ORDER BY i) AS text FROM f GROUP BY doc_id, g")
def q_pack_lines_200(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")  # a bare F.trim would take the index for its second argument
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pack.packed(lines, 200, "\n\n")).alias("piece", "text"))


# Sentences, by a mark put in where one ends: the engine looks ahead, which this SQL can't.
_SENTENCES = r"""string_split(regexp_replace({0}, '([.!?…])\s+([A-ZÁÉÍÓÚÑ"«—])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


@query(FOLD_SQL.format(parts=_SENTENCES.format("text"), first=_TOK.format(1), group=f"CASE WHEN c + {_TOK.format('i + 1')} > 200 THEN g + 1 ELSE g END", count=f"CASE WHEN c + {_TOK.format('i + 1')} > 200 THEN {_TOK.format('i + 1')} ELSE c + {_TOK.format('i + 1')} END")
       + " SELECT doc_id, CAST(g AS INTEGER) AS piece, string_agg(l[i], ' ' ORDER BY i) AS text FROM f GROUP BY doc_id, g")
def q_pack_sentences_200(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pack.by_sentences(F.col("text"), 200)).alias("piece", "text"))


_N = "len(regexp_extract_all({0}, '\\S+'))"
# Groups of parts of one key under a sum of tokens, as a step of a longer statement: from (key, l) to (key, g, text).
_GROUPS = r"""
{0}_f AS (SELECT key, l, 1 AS i, 0 AS g, floor({n1} * 1.3::DOUBLE) AS c FROM {0} WHERE len(l) > 0 UNION ALL
          SELECT key, l, i + 1, CASE WHEN c + floor({ni} * 1.3::DOUBLE) > 300 THEN g + 1 ELSE g END, CASE WHEN c + floor({ni} * 1.3::DOUBLE) > 300 THEN floor({ni} * 1.3::DOUBLE) ELSE c + floor({ni} * 1.3::DOUBLE) END FROM {0}_f WHERE i < len(l)),
{0}_g AS (SELECT key, g, string_agg(l[i], {joint} ORDER BY i) AS text FROM {0}_f GROUP BY key, g)
"""
_groups = lambda name, joint: _GROUPS.format(name, joint=joint, n1=_N.format("l[1]"), ni=_N.format("l[i + 1]"))
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH RECURSIVE {SEGMENTS_SQL},
para AS (SELECT {{'d': doc_id, 's': seg_no}} AS key, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS l, text FROM seg WHERE token_estimated > 300),
many AS (SELECT key, l FROM para WHERE len(l) > 1), {_groups('many', 'chr(10) || chr(10)')},
one AS (SELECT key, 0 AS g, text FROM para WHERE len(l) <= 1 UNION ALL SELECT key, g, text FROM many_g),
sent AS (SELECT {{'k': key, 'g': g}} AS key, {_SENTENCES.format('text')} AS l FROM one WHERE floor({_N.format('text')} * 1.3::DOUBLE) > 300), {_groups('sent', "' '")},
piece AS (SELECT doc_id, source, seg_no, 0 AS g, 0 AS h, boundary_type, original_position, text FROM seg WHERE token_estimated <= 300
          UNION ALL SELECT key.d, NULL, key.s, g, 0, 'paragraph', NULL, text FROM one WHERE floor({_N.format('text')} * 1.3::DOUBLE) <= 300
          UNION ALL SELECT key.k.d, NULL, key.k.s, key.g, g, 'paragraph', NULL, text FROM sent_g),
num AS (SELECT p.doc_id, d.source, row_number() OVER (PARTITION BY p.doc_id ORDER BY seg_no, g, h) AS i, boundary_type, p.text AS text, {_N.format('p.text')} AS n FROM piece p JOIN documents d USING (doc_id)),
mrg AS (SELECT doc_id, i, 0 AS g, n AS words, boundary_type AS b FROM num WHERE i = 1 UNION ALL
        SELECT doc_id, x.i, CASE WHEN can THEN x.g ELSE x.g + 1 END, CASE WHEN can THEN x.words + x.n ELSE x.n END, CASE WHEN can THEN x.b ELSE x.nb END
        FROM (SELECT m.doc_id, s.i, m.g, m.words, m.b, s.n, s.boundary_type AS nb, floor(m.words * 1.3::DOUBLE) < 100 AND floor(m.words * 1.3::DOUBLE) + floor(s.n * 1.3::DOUBLE) <= 300 AND s.boundary_type <> 'chapter' AND m.b <> 'chapter' AS can
              FROM mrg m JOIN num s ON s.doc_id = m.doc_id AND s.i = m.i + 1) x),
chk AS (SELECT doc_id, source, g, string_agg(text, chr(10) || chr(10) ORDER BY i) AS original, sum(n) AS n, arg_min(boundary_type, i) AS boundary_type FROM num JOIN mrg USING (doc_id, i) GROUP BY doc_id, source, g)
SELECT source, doc_id, CAST(g AS INTEGER) AS chunk_index, original, CAST(floor(n * 1.3::DOUBLE) AS INTEGER) AS token_estimated, boundary_type, 'pending' AS status, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, g) - 1 AS INTEGER) AS book_index FROM chk""")  # fmt: skip
def q_chunks(spark, sf_dir):
    segs = segment.segments(marked(spark, sf_dir), "source", "doc_id")
    return pack.indexed(pack.chunks(segs, 100, 300, "source", "doc_id"), "source", "doc_id")


@query(FOLD_SQL.format(parts=_BLOCKS, first="length(l[1])", group="CASE WHEN c + 2 + length(l[i + 1]) > 1200 THEN g + 1 ELSE g END", count="CASE WHEN c + 2 + length(l[i + 1]) > 1200 THEN length(l[i + 1]) ELSE c + 2 + length(l[i + 1]) END")
       + " SELECT doc_id, CAST(g AS INTEGER) AS piece, string_agg(l[i], chr(10) || chr(10) ORDER BY i) AS text FROM f GROUP BY doc_id, g")
def q_char_chunks_1200(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pack.char_chunks(text)).alias("piece", "text"))


@query(r"""WITH f AS (SELECT doc_id, source, trim(regexp_replace(trim(string_split(trim(text, ' ' || chr(10)), chr(10))[1]), '^#+', '')) AS t FROM documents)
SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '\S+')) BETWEEN 1 AND 10 AND NOT ends_with(t, '.') THEN t ELSE source END AS title FROM f""")
def q_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_of(F.col("text"), F.col("source")).alias("title"))


HTML_SQL = r"regexp_replace(regexp_replace(html, '<(p|br|div|h[1-6]|li|tr|blockquote)[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g')"
for _e, _c in L.ENTITIES:
    HTML_SQL = f"replace({HTML_SQL}, {quoted([_e])}, {quoted([_c])})"
HTML_SQL = rf"regexp_replace(regexp_replace(regexp_replace({HTML_SQL}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {HTML_SQL} AS text FROM pages")
def q_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, n_words FROM (SELECT page_id, len(regexp_extract_all({HTML_SQL}, '\\S+'))::INTEGER AS n_words FROM pages) WHERE n_words >= 50")
def q_html_wordcount(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(T.words(T.html_to_text(F.col("html")))).alias("n_words")).where("n_words >= 50")


# Names with Spanish context put in, as the fixtures hold few such verbs.
STAGED_SQL = r"staged AS (SELECT doc_id, text || ' El señor Duarte dijo. Entonces Duarte miró el castillo de Tempest. ' || substr(text, 1, 200) AS text FROM documents)"


def staged(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" El señor Duarte dijo. Entonces Duarte miró el castillo de Tempest. "), F.substring("text", 1, 200)).alias("text"))


FOLDED_SQL = "trim(lower(strip_accents({0})))"
_VERB = lambda v: "(?:" + "|".join(v) + ")"
EVIDENCE_SQL = STAGED_SQL + rf""",
tok AS (SELECT doc_id, text, regexp_extract_all(text, '[\pL\pN_]+') AS w, string_split_regex(text, '[\pL\pN_]+') AS g FROM staged),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, text, w, g FROM tok),
off AS (SELECT doc_id, i, w[i] AS name, text, sum(length(g[i]) + length(w[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(w[i]) AS start FROM pos),
nam AS (SELECT doc_id, name, CAST(start AS INTEGER) AS start, text FROM off WHERE regexp_full_match(name, '{L.NAME}')),
cut AS (SELECT *, substr(text, start + length(name) + 1, 42) AS a42, substr(text, start + length(name) + 1, 24) AS a24, substr(text, greatest(start - 42, 0) + 1, least(start, 42)) AS b42,
        regexp_extract(substr(text, greatest(start - 20, 0) + 1, least(start, 20)), '([A-Za-zÁÉÍÓÚÑáéíóúñ]+)[^A-Za-zÁÉÍÓÚÑáéíóúñ]*$', 1) AS l20,
        regexp_extract(substr(text, greatest(start - 25, 0) + 1, least(start, 25)), '([A-Za-zÁÉÍÓÚÑáéíóúñ]+)[^A-Za-zÁÉÍÓÚÑáéíóúñ]*$', 1) AS l25,
        rtrim(substr(text, 1, start), ' ' || chr(10) || chr(9)) AS head FROM nam),
ev AS (SELECT doc_id, name, start, {FOLDED_SQL.format('name')} AS norm, head = '' OR right(head, 1) IN ('.', '!', '?') AS sentence_start,
       regexp_matches(b42, '(?i)(^|[^\pL\pN_]){_VERB(L.SPEECH)}\s+' || name || '($|[^\pL\pN_])') OR regexp_matches(a42, '(?i)^\s+{_VERB(L.SPEECH)}($|[^\pL\pN_])') AS speech,
       regexp_matches(a24, '(?i)^\s+{_VERB(L.ACTION)}($|[^\pL\pN_])') AS action, {FOLDED_SQL.format('l20')} IN ({quoted(L.TITLES)}) AS title, {FOLDED_SQL.format('l25')} IN ({quoted(L.GENITIVE)}) AS genitive FROM cut),
st AS (SELECT doc_id, norm, count(*) AS occurrences, min(start) AS first_index, arg_min(name, start) AS display, count(*) FILTER (WHERE sentence_start) AS sentence_start_hits, count(*) FILTER (WHERE speech) AS speech_hits,
       count(*) FILTER (WHERE action) AS action_hits, count(*) FILTER (WHERE title) AS title_hits, count(*) FILTER (WHERE genitive) AS genitive_hits FROM ev GROUP BY doc_id, norm)
"""
SCORE_SQL = "least(occurrences, 3) + 3 * speech_hits + 3 * action_hits + 2 * title_hits - CASE WHEN occurrences = sentence_start_hits THEN 2 ELSE 0 END"
_PLAIN_VERBS = sorted({*mentions._plain(L.SPEECH), *mentions._plain(L.ACTION)})
FIT_SQL = f"""norm NOT IN ({quoted(L.NOT_NAMES)}) AND norm NOT IN ({quoted(_PLAIN_VERBS)}) AND (speech_hits + action_hits + title_hits > 0 OR genitive_hits < occurrences)
 AND {SCORE_SQL} >= 2 AND (speech_hits + action_hits + title_hits > 0 OR (occurrences >= 2 AND sentence_start_hits < occurrences))"""


@query(f"WITH {STAGED_SQL}, tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\pL\\pN_]+')) AS w FROM staged) SELECT doc_id, w AS name, count(*) AS n FROM tok WHERE regexp_full_match(w, '{L.NAME}') GROUP BY doc_id, w")
def q_name_tokens(spark, sf_dir):
    return mentions.name_tokens(staged(spark, sf_dir), "doc_id").groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(f"WITH {EVIDENCE_SQL} SELECT doc_id, norm, occurrences, first_index, display, sentence_start_hits, speech_hits, action_hits, title_hits, genitive_hits FROM st")
def q_mention_evidence(spark, sf_dir):
    return mentions.stats(mentions.evidence(staged(spark, sf_dir), "doc_id"), "doc_id")


@query(f"WITH {EVIDENCE_SQL}, r AS (SELECT doc_id, display AS name, ({SCORE_SQL})::INTEGER AS score, occurrences, row_number() OVER (PARTITION BY doc_id ORDER BY {SCORE_SQL} DESC, occurrences DESC, first_index, display DESC) AS rank FROM st WHERE {FIT_SQL}) SELECT doc_id, CAST(rank AS INTEGER) AS rank, name, score, occurrences FROM r WHERE rank <= 6")
def q_character_topk(spark, sf_dir):
    return mentions.character_mentions(staged(spark, sf_dir), "doc_id")


@query(f"""WITH {EVIDENCE_SQL}, known AS (SELECT doc_id, 'TEMPEST' AS known, 'tempest' AS norm FROM documents WHERE doc_id % 2 = 0),
k AS (SELECT st.*, known FROM st LEFT JOIN known USING (doc_id, norm)),
r AS (SELECT doc_id, coalesce(known, display) AS name, CASE WHEN known IS NOT NULL THEN 100 + occurrences ELSE {SCORE_SQL} END AS score, occurrences, first_index FROM k WHERE known IS NOT NULL OR ({FIT_SQL})),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, occurrences DESC, first_index, name DESC) AS rank FROM r)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, name, score::INTEGER AS score, occurrences FROM o WHERE rank <= 6""")
def q_known_names(spark, sf_dir):
    known = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit("TEMPEST").alias("name"))
    return mentions.character_mentions(staged(spark, sf_dir), "doc_id", known=known)


@query(f"WITH {STAGED_SQL}, tok AS (SELECT {FOLDED_SQL.format('w')} AS norm FROM (SELECT unnest(regexp_extract_all(text, '[\\pL\\pN_]+')) AS w FROM staged) WHERE regexp_full_match(w, '{L.NAME}')) SELECT norm, count(*) AS n FROM tok WHERE norm NOT IN ({quoted(L.NOT_NAMES)}) GROUP BY norm")
def q_stopword_anti(spark, sf_dir):
    stop = F.broadcast(spark.createDataFrame([(w,) for w in sorted(set(L.NOT_NAMES))], "norm string"))  # a fixed list
    names = mentions.name_tokens(staged(spark, sf_dir), "doc_id").select(T.folded(F.col("name")).alias("norm"))
    return names.join(stop, "norm", "left_anti").groupBy("norm").agg(F.count("*").alias("n"))


TERMS_SQL = "terms AS (SELECT item_id, lower(regexp_extract(text, '[\\pL]{5,}')) AS term FROM benchmark)"


def terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.regexp_extract("text", r"[\p{L}]{5,}", 0)).alias("term")).where("term <> ''")


@query(f"WITH {TERMS_SQL} SELECT doc_id, count(*) AS kept, string_agg(term, ',' ORDER BY term, item_id) AS terms FROM documents JOIN terms ON term <> '' AND contains(lower(text), term) GROUP BY doc_id")
def q_context_compress(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = memory.relevant_terms(docs, terms(spark, sf_dir))
    return hits.groupBy("doc_id").agg(F.count("*").alias("kept"), F.expr("listagg(term, ',') WITHIN GROUP (ORDER BY term)").alias("terms"))


@query(f"WITH {TERMS_SQL} SELECT doc_id, count(*) FILTER (WHERE contains(lower(text), term))::DOUBLE / count(*) AS ratio FROM documents CROSS JOIN (SELECT DISTINCT term FROM terms WHERE term <> '') GROUP BY doc_id")
def q_compression_ratio(spark, sf_dir):
    glossary = terms(spark, sf_dir).select("term").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = memory.relevant_terms(docs, glossary).groupBy("doc_id").agg(F.count("*").alias("kept"))
    total = F.lit(glossary.count())  # one number
    return docs.join(kept, "doc_id", "left").select("doc_id", memory.ratio(F.coalesce("kept", F.lit(0)), total).alias("ratio"))


_CUE = lambda cues: " + ".join(f"contains(low, '{c}')::INTEGER" for c in cues)
_SPOKEN = "SELECT conv_id, turn, text || ' y yo me fui; él dijo que su casa está aquí y nos miró.' AS text FROM conversations"


@query(f"""WITH s AS (SELECT conv_id, turn, text, ' ' || lower(text) || ' ' AS low FROM ({_SPOKEN})),
c AS (SELECT *, {_CUE(L.FIRST_PERSON)} AS p1, {_CUE(L.THIRD_PERSON)} AS p3, list_filter(regexp_extract_all(low, '[\\pL\\pN_]+'), lambda x: x IN ({quoted(L.PAST)})) AS pa, list_filter(regexp_extract_all(low, '[\\pL\\pN_]+'), lambda x: x IN ({quoted(L.PRESENT)})) AS pr FROM s)
SELECT conv_id, turn, 'narrador en ' || CASE WHEN p1 >= greatest(2, p3 + 1) THEN 'primera persona' ELSE 'tercera persona' END || ', ' || CASE WHEN len(pa) >= len(pr) THEN 'tiempo pasado' ELSE 'tiempo presente' END AS voice FROM c""")
def q_voice(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" y yo me fui; él dijo que su casa está aquí y nos miró.")).alias("text"))
    return rows.select("conv_id", "turn", T.voice(F.col("text"), F.lit("")).alias("voice"))


@query(rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
m AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM c),
d AS (SELECT doc_id, t, trim(array_to_string(s[1:2], ' ')) AS two FROM m)
SELECT doc_id, CASE WHEN t = '' THEN '{L.NO_SCENE}' WHEN length(two) > 280 THEN rtrim(left(two, 279)) || '…' ELSE two END AS digest FROM d""")
def q_scene_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.scene_digest(F.col("text")).alias("digest"))


@query(f"""WITH n AS (SELECT conv_id, turn, text || '. Mantener el tono. Nada. Usar tú' || text AS notes FROM conversations)
SELECT conv_id, turn, list_filter(list_transform(string_split(notes, '.'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda p: len(list_filter([{quoted(L.STYLE_KEYWORDS)}], lambda k: contains(lower(p), k))) > 0)[1:5] AS decisions FROM n""")
def q_style_decisions(spark, sf_dir):
    notes = F.concat("text", F.lit(". Mantener el tono. Nada. Usar tú"), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.style_decisions(notes).alias("decisions"))


STATUS_SQL = "SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'pending' WHEN 0.5 + 0.4 * quality >= 0.75 THEN 'done' ELSE 'flagged' END AS status FROM documents LEFT JOIN labels USING (doc_id)"


def statuses(spark, sf_dir):
    sure = F.lit(0.5) + F.lit(0.4) * F.col("quality")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", F.when(F.col("quality").isNull(), "pending").otherwise(T.status_of(sure)).alias("status"))


@query(STATUS_SQL)
def q_status_by_confidence(spark, sf_dir):
    return statuses(spark, sf_dir)


@query(f"SELECT source, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'flagged') AS flagged, count(*) FILTER (WHERE status = 'pending') AS pending FROM ({STATUS_SQL}) GROUP BY source")
def q_status_counts(spark, sf_dir):
    return state.counts(statuses(spark, sf_dir), "source")


CALLS_SQL = "calls AS (SELECT event_id, event_type AS model, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS tokens FROM events)"


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.to_date("ts").alias("day"), F.floor("value").cast("long").alias("tokens"))


@query(f"WITH {CALLS_SQL} SELECT model, day, coalesce(sum(tokens), 0)::BIGINT AS tokens_used FROM calls GROUP BY model, day")
def q_quota_daily(spark, sf_dir):
    return state.quota(calls(spark, sf_dir), "model", "day", "tokens")


@query(f"WITH {CALLS_SQL} SELECT event_id, model, used_before::BIGINT AS used_before, used_before < 500 AS usable FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY model, day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM calls)")
def q_quota_usable(spark, sf_dir):
    return routing.usable(calls(spark, sf_dir), "model", "day", "event_id", "tokens", 500).select("event_id", "model", "used_before", "usable")


ROUTE_SQL = f"""
r0 AS (SELECT conv_id, turn, {TOKENS_SQL.format('text')} AS tokens FROM conversations),
r1 AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS a FROM r0),
r2 AS (SELECT *, coalesce(sum(CASE WHEN NOT a THEN tokens END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS b FROM r1),
route AS (SELECT conv_id, turn, tokens, CASE WHEN a THEN 'first' WHEN b THEN 'second' END AS model FROM r2)
"""


def routed(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.est_tokens(F.col("text")).alias("tokens"))
    return routing.plan(rows, [("second", 2, 60), ("first", 1, 60)], "conv_id", "turn", "tokens")


@query(f"WITH {ROUTE_SQL} SELECT conv_id, turn, tokens, model FROM route")
def q_route_plan(spark, sf_dir):
    return routed(spark, sf_dir)


@query(f"WITH {ROUTE_SQL}, s AS (SELECT *, min(CASE WHEN model IS NULL THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM route) SELECT conv_id, turn, tokens, model FROM s WHERE stop IS NULL OR turn < stop")
def q_pause_point(spark, sf_dir):
    return routing.pause_points(routed(spark, sf_dir), "conv_id", "turn")


@query(f"""WITH g AS (SELECT conv_id, turn, turn = 0 OR len(list_filter([{quoted(L.GATE_KEYWORDS)}], lambda k: contains(lower(text), k))) > 0 AS loud FROM conversations),
i AS (SELECT *, sum(loud::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT conv_id, turn, loud OR sum((NOT loud)::INTEGER) OVER (PARTITION BY conv_id, island ORDER BY turn ROWS UNBOUNDED PRECEDING) % 3 = 0 AS extract FROM i""")
def q_extraction_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return routing.gate(rows, "conv_id", "turn", T.speaks_of_news(F.col("text")), F.lit(False), 3).select("conv_id", "turn", "extract")


@query(f"""WITH RECURSIVE g AS (SELECT conv_id, turn, turn = 0 OR len(list_filter([{quoted(L.GATE_KEYWORDS)}], lambda k: contains(lower(text), k))) > 0 AS loud, length(text) % 3 <> 0 AS ok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, loud AS extract, CASE WHEN loud AND ok THEN 0 WHEN loud THEN 0 ELSE 1 END AS quiet FROM g WHERE k = 1
      UNION ALL SELECT g.conv_id, g.turn, g.k, g.loud OR r.quiet + 1 >= 3, CASE WHEN g.loud THEN CASE WHEN ok THEN 0 ELSE r.quiet END WHEN r.quiet + 1 >= 3 AND ok THEN 0 ELSE r.quiet + 1 END FROM r JOIN g ON g.conv_id = r.conv_id AND g.k = r.k + 1)
SELECT conv_id, turn, extract FROM r""")
def q_extraction_gate_failures(spark, sf_dir):
    """An extraction fails where the text's length is a multiple of 3: the count of quiet chunks then goes on."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return routing.gate(rows, "conv_id", "turn", T.speaks_of_news(F.col("text")), F.lit(False), 3, F.length("text") % 3 != 0).select("conv_id", "turn", "extract")


@query(f"""WITH RECURSIVE e AS (SELECT client_id, click_id, coalesce(kind, '') IN ('buy', 'purchase', 'signup') AS loud, coalesce(value, 0) < 50 AS ok, row_number() OVER (PARTITION BY client_id ORDER BY click_id) AS k FROM (SELECT click_id, client_id, min(kind) AS kind, min(value) AS value FROM clicks WHERE client_id IS NOT NULL AND click_id IS NOT NULL GROUP BY ALL)),
r AS (SELECT client_id, click_id, k, loud OR click_id = 0 AS extract, CASE WHEN loud OR click_id = 0 THEN 0 ELSE 1 END AS quiet FROM e WHERE k = 1
      UNION ALL SELECT e.client_id, e.click_id, e.k, e.loud OR r.quiet + 1 >= 5, CASE WHEN e.loud THEN CASE WHEN ok THEN 0 ELSE r.quiet END WHEN r.quiet + 1 >= 5 AND ok THEN 0 ELSE r.quiet + 1 END FROM r JOIN e ON e.client_id = r.client_id AND e.k = r.k + 1)
SELECT client_id, click_id, extract FROM r""")
def q_gate_skewed(spark, sf_dir):
    """The same automaton over a log of clicks, where one client may have a third of all rows."""
    rows = table(spark, sf_dir, "clicks").where("client_id is not null and click_id is not null").groupBy("client_id", "click_id").agg(F.min("kind").alias("kind"), F.min("value").alias("value"))
    loud = F.coalesce("kind", F.lit("")).isin("buy", "purchase", "signup")
    return routing.gate(rows, "client_id", "click_id", loud, F.lit(False), 5, F.coalesce("value", F.lit(0)) < 50).select("client_id", "click_id", "extract")


@query("""WITH f AS (SELECT l_partkey, l_returnflag, arg_min(l_shipdate::DATE, l_orderkey * 10 + l_linenumber) AS value, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY first, l_partkey) AS place FROM f) SELECT l_returnflag AS book, l_partkey AS term, value, CAST(place AS INTEGER) AS place FROM p WHERE place <= 600""")
def q_first_writer_glossary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("book"), F.col("l_partkey").alias("term"), F.to_date("l_shipdate").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return memory.first_written(rows, "book", ["at"])


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN nullif(trim(text, ' ' || chr(10)), '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_scene FROM conversations""")
def q_last_scene_so_far(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return memory.last_so_far(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")), "last_scene").select("conv_id", "turn", "last_scene")


@query("SELECT user_id, count(*) AS version, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id")
def q_latest_version(spark, sf_dir):
    rows = state.versions(table(spark, sf_dir, "events"), "user_id", "event_id")
    return state.latest_version(rows, "user_id", "event_type").select("user_id", F.col("version").cast("long").alias("version"), F.col("event_type").alias("kind"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS version FROM events")
def q_version_seq(spark, sf_dir):
    return state.versions(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "version")


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def q_latest_state(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    return state.latest(rows, "o_custkey")


def stored(rows: DataFrame, keys: tuple[str, ...], order: str, prune: str, batches: int = 3, parts: int = 64) -> StateTable:
    """A state table of rows that came in batches, with a snapshot below the last batch."""
    spark = rows.sparkSession
    out = StateTable(spark, f"{shared(spark)}/state-{uuid4().hex}", rows.schema, keys, order, prune, parts)
    for k in range(batches):
        out.append(rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(batches)) == k), k)
    out.compact(batches - 2)
    return out


def changes(spark, sf_dir):
    rows = table(spark, sf_dir, "client_changes").select("client_id", "seq", "op", "source", "segment", "city", "balance")
    return stored(rows, ("client_id",), "seq", "client_id")


CHANGES_SQL = "SELECT client_id, max(seq) AS seq, " + ", ".join(f"arg_max({c}, (seq, {c})) FILTER (seq IS NOT NULL AND {c} IS NOT NULL) AS {c}" for c in ("op", "source", "segment", "city", "balance")) + " FROM client_changes"


@query(f"{CHANGES_SQL} GROUP BY client_id")
def q_state_current(spark, sf_dir):
    return changes(spark, sf_dir).current()


@query(f"{CHANGES_SQL} WHERE client_id = 7 GROUP BY client_id")
def q_state_lookup(spark, sf_dir):
    return changes(spark, sf_dir).lookup(7)


@query("SELECT sha256(text) AS file_hash, max(doc_id) AS doc_id, arg_max(source, (doc_id, source)) FILTER (source IS NOT NULL) AS source FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)) GROUP BY 1")
def q_book_by_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), "doc_id", "source")
    wanted = rows.agg(F.min_by("file_hash", "doc_id")).first()[0]  # one string
    return stored(rows, ("file_hash",), "doc_id", "file_hash").lookup(wanted)


@query(f"WITH {CALLS_SQL} SELECT model, day, coalesce(sum(tokens), 0)::BIGINT AS tokens_used FROM calls WHERE day = DATE '2024-01-10' GROUP BY model, day")
def q_usage_of_day(spark, sf_dir):
    rows = stored(calls(spark, sf_dir).withColumn("seq", F.col("event_id")), ("event_id", "day"), "seq", "day", parts=0)
    return state.quota(rows.lookup("2024-01-10"), "model", "day", "tokens")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_resume_pending(spark, sf_dir):
    return state.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def q_insert_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return state.new_rows(rows, table(spark, sf_dir, "part").where("p_size < 25"), "p_partkey")


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def q_dedup_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT item_id, sha256('fix|' || sha256(text) || '|' || sha256('x')) AS fix_key, sha256('fix_style|es|' || sha256(text)) AS polish_key FROM benchmark")
def q_identity_keys(spark, sf_dir):
    h = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, sf_dir, "benchmark").select("item_id", T.fix_key(h, F.sha2(F.lit("x").cast("binary"), 256)).alias("fix_key"), T.polish_key("ES", h).alias("polish_key"))


@query(f"""WITH r AS (SELECT conv_id, turn, turn // 3 AS section, CASE WHEN role = 'assistant' THEN reverse(text) WHEN role = 'system' THEN '{L.REVIEW_MARKER.strip()}' || chr(10) || text ELSE text END AS t FROM conversations),
p AS (SELECT *, CASE WHEN section <> lag(section) OVER (PARTITION BY conv_id ORDER BY turn) THEN repeat(chr(10), 4) || t ELSE t END AS part FROM r)
SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY turn) AS text FROM p GROUP BY conv_id""")
def q_reassemble(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("section", F.floor(F.col("turn") / 3))
    text = assemble.chosen_text(F.when(F.col("role") == "assistant", F.reverse("text")), F.when(F.col("role") == "system", "flagged").otherwise("done"), F.col("text"))
    return assemble.reassembled(rows, "conv_id", "turn", "section", text)


@query("""WITH t AS (SELECT conv_id, turn, sum(greatest(length(text), 1)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS c, sum(greatest(length(text), 1)) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn, CAST(round_even(c / total::DOUBLE * 1000, 0) AS INTEGER) AS target FROM t""")
def q_align_targets(spark, sf_dir):
    return assemble.targets(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), F.lit(1000)).select("conv_id", "turn", "target")


ALIGN_SQL = r"""c AS (SELECT conv_id, coalesce(list(greatest(length(text), 1) ORDER BY turn) FILTER (WHERE role = 'user'), []) AS sizes, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS draft FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, draft, length(draft) AS n, [CAST(round_even(list_sum(sizes[1:k]) / list_sum(sizes)::DOUBLE * length(draft), 0) AS BIGINT) FOR k IN range(1, len(sizes))] AS goals FROM c WHERE len(sizes) > 0),
a AS (SELECT conv_id, draft, n, goals, 0 AS k, 0::BIGINT AS start, 0::BIGINT AS before FROM t UNION ALL
      SELECT conv_id, draft, n, goals, k + 1, CASE WHEN k = len(goals) OR start >= n OR start + 1 > n - 1 THEN n ELSE
        coalesce((list_min([{'far': abs(i - goal), 'pos': i} FOR i IN range(greatest(start + 1, goal - 120), least(n - 1, goal + 120) + 1) IF substr(draft, i, 1) = chr(10) OR (substr(draft, i, 1) IN ('.', '?', '!', ';', ':') AND regexp_matches(substr(draft, i + 1, 1), '\s'))])).pos, goal) END, start
      FROM (SELECT *, greatest(start + 1, least(goals[k + 1], n - 1)) AS goal FROM a WHERE k <= len(goals)))
"""
_PIECE = r"regexp_replace(substr(draft, before + 1, start - before), '^\s+|\s+$', '', 'g')"


@query(f"WITH RECURSIVE {ALIGN_SQL} SELECT conv_id, CAST(k - 1 AS INTEGER) AS chunk_index, {_PIECE} AS piece FROM a WHERE k > 0")
def q_align_split(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    by = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    both = rows.groupBy("conv_id").agg(by("user").alias("source"), F.array_join(by("assistant"), "\n\n").alias("draft"))
    return both.where(F.size("source") > 0).select("conv_id", F.posexplode(assemble.aligned(F.col("draft"), F.transform("source", F.length))).alias("chunk_index", "piece"))


_ENDS = """regexp_matches(regexp_replace(w[i], '["''»)]+$', ''), '[.!?]$')"""
_CUT = lambda at: f"coalesce([i FOR i IN range(greatest({at}, 1), least(n, {at} + 20)) IF {_ENDS}][1], [i FOR i IN range({at}, greatest(0, {at} - 20), -1) IF {_ENDS}][1], {at})"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM documents),
a AS (SELECT *, least(CAST(round_even(120 / 400::DOUBLE * n, 0) AS BIGINT), n) AS t FROM (SELECT *, len(w) AS n FROM d)),
b AS (SELECT doc_id, w, n, {_CUT('t')} AS one FROM a),
c AS (SELECT *, least(one + CAST(round_even(80 / 400::DOUBLE * n, 0) AS BIGINT), n) AS t FROM b),
e AS (SELECT doc_id, w, n, one, {_CUT('t')} AS two FROM c),
f AS (SELECT doc_id, w, unnest([{{'page': 0, 'low': 0, 'high': one}}, {{'page': 1, 'low': one, 'high': two}}, {{'page': 2, 'low': two, 'high': n}}]) AS p FROM e)
SELECT doc_id, p.page AS page, CASE WHEN p.high > p.low THEN array_to_string(w[p.low + 1:p.high], ' ') ELSE '' END AS text FROM f""")  # fmt: skip
def q_page_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(assemble.page_words(F.col("text"), F.array(F.lit(120), F.lit(80), F.lit(200)))).alias("page", "text"))


_SETS = "s AS (SELECT source, list_distinct(list(lang || doc_id % 7) FILTER (WHERE doc_id % 2 = 0)) AS gold, list_distinct(list(lang || doc_id % 7) FILTER (WHERE doc_id % 3 = 0)) AS pred FROM documents GROUP BY source)"


def name_sets(spark, sf_dir):
    name = F.concat("lang", (F.col("doc_id") % 7).cast("string"))
    pick = lambda n: F.collect_set(F.when(F.col("doc_id") % n == 0, name))
    return table(spark, sf_dir, "documents").groupBy("source").agg(pick(2).alias("gold"), pick(3).alias("pred"))


@query(f"""WITH {_SETS}, m AS (SELECT source, len(list_intersect(coalesce(gold, []), coalesce(pred, [])))::INTEGER AS tp, len(coalesce(pred, []))::INTEGER AS pred, len(coalesce(gold, []))::INTEGER AS gold FROM s),
p AS (SELECT *, CASE WHEN pred = 0 THEN 0.0::DOUBLE ELSE tp / pred::DOUBLE END AS precision, CASE WHEN gold = 0 THEN 0.0::DOUBLE ELSE tp / gold::DOUBLE END AS recall FROM m)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p""")
def q_eval_exact(spark, sf_dir):
    return name_sets(spark, sf_dir).select("source", *assemble.exact_metrics(F.col("gold"), F.col("pred")))


@query(f"WITH {_SETS} SELECT source, list_sort(list_filter(coalesce(pred, []), lambda x: NOT list_contains(coalesce(gold, []), x))) AS extra, list_sort(list_filter(coalesce(gold, []), lambda x: NOT list_contains(coalesce(pred, []), x))) AS missing FROM s")
def q_extra_missing(spark, sf_dir):
    return name_sets(spark, sf_dir).select("source", F.array_sort(F.array_except("pred", "gold")).alias("extra"), F.array_sort(F.array_except("gold", "pred")).alias("missing"))


# Similarity of the texts a and b of pairs: common blocks, the longest first, then on both sides of it.
_BLOCK = "list_max([{{'n': len(list_filter(range(1, length({x}) - i + 1), lambda k: contains({y}, {x}[i + 1:i + k]))), 'i': -i}} FOR i IN range(length({x}))])"
SIMILAR_SQL = f"""
w AS (SELECT a, b, a AS x, b AS y, {_BLOCK.format(x="a", y="b")} AS m FROM pairs WHERE a <> '' AND b <> ''
      UNION ALL
      SELECT a, b, c.x, c.y, {_BLOCK.format(x="c.x", y="c.y")} FROM (
        SELECT a, b, unnest([{{'x': x[:-m.i], 'y': y[:instr(y, x[1 - m.i:m.n - m.i]) - 1]}}, {{'x': x[1 - m.i + m.n:], 'y': y[instr(y, x[1 - m.i:m.n - m.i]) + m.n:]}}]) AS c FROM w WHERE m.n > 0) WHERE c.x <> '' AND c.y <> ''),
scored AS (SELECT a, b, 2.0::DOUBLE * sum(m.n) / (length(a) + length(b)) AS score FROM w GROUP BY a, b)
"""
# Each predicted name in order takes its best gold name that is left.
GREEDY_SQL = f"""
edges AS (SELECT source, p, list(g ORDER BY score DESC, g) AS golds FROM candidates JOIN scored ON a = lower(p) AND b = lower(g) WHERE score >= {L.SIMILAR} GROUP BY source, p),
steps AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p) AS k FROM edges),
taking AS (SELECT source, 0::BIGINT AS k, []::VARCHAR[] AS taken FROM (SELECT DISTINCT source FROM documents)
           UNION ALL SELECT t.source, s.k, CASE WHEN len(list_filter(golds, lambda g: NOT list_contains(taken, g))) > 0 THEN list_append(taken, list_filter(golds, lambda g: NOT list_contains(taken, g))[1]) ELSE taken END
           FROM taking t JOIN steps s ON s.source IS NOT DISTINCT FROM t.source AND s.k = t.k + 1)
SELECT source, CAST(max(len(taken)) AS INTEGER) AS tp FROM taking GROUP BY source
"""


@query(f"""WITH RECURSIVE {_SETS}, candidates AS (SELECT source, p, unnest(gold) AS g FROM (SELECT source, unnest(pred) AS p, gold FROM s)),
pairs AS (SELECT DISTINCT lower(p) AS a, lower(g) AS b FROM candidates), {SIMILAR_SQL}, {GREEDY_SQL}""")
def q_eval_fuzzy(spark, sf_dir):
    return assemble.fuzzy_hits(name_sets(spark, sf_dir), "source")


_WORDS = "s AS (SELECT source, list(DISTINCT w) FILTER (WHERE doc_id % 2 = 0 AND w <> '') AS gold, list(DISTINCT w) FILTER (WHERE doc_id % 2 = 1 AND w <> '') AS pred FROM (SELECT source, doc_id, unnest(regexp_extract_all(text, '[\\pL]{6,}')) AS w FROM documents) GROUP BY source)"


@query(f"""WITH RECURSIVE {_WORDS}, candidates AS (SELECT source, p, unnest(gold) AS g FROM (SELECT source, unnest(pred) AS p, gold FROM s)),
pairs AS (SELECT DISTINCT lower(p) AS a, lower(g) AS b FROM candidates WHERE 2.0 * least(length(p), length(g)) >= {L.SIMILAR} * (length(p) + length(g))), {SIMILAR_SQL}, {GREEDY_SQL}""")
def q_eval_fuzzy_words(spark, sf_dir):
    """The long words of each text, of every second text as gold names and of the others as predicted ones."""
    docs = table(spark, sf_dir, "documents")
    words = kept(docs.select("source", (F.col("doc_id") % 2).alias("side"), F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]{6,}"), F.lit(0))).alias("name")).distinct())
    pick = lambda n: words.where(F.col("side") == n).select("source", "name")
    return assemble.name_hits(docs.select("source").distinct(), pick(0), pick(1), "source")


@query("""WITH r AS (SELECT doc_id, quality, source FROM labels JOIN documents USING (doc_id))
SELECT doc_id, source AS translation, CASE WHEN doc_id % 4 = 3 THEN 0.3::DOUBLE ELSE least(1.0::DOUBLE, quality + 0.5::DOUBLE) END AS confidence,
       CASE WHEN doc_id % 4 = 3 THEN 'Respuesta no estructurada.' ELSE 'n' || toxic END AS notes FROM r JOIN labels USING (doc_id, quality)""")
def q_reply_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    # confidence is a string here, and over 1 for some: it is cast and clamped
    body = F.to_json(F.struct(F.col("source").alias("translation"), (F.col("quality") + 0.5).cast("string").alias("confidence"), F.concat(F.lit("n"), F.col("toxic").cast("string")).alias("notes")))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n"))).when(kind == 2, F.concat(F.lit("The reply is "), body, F.lit(" as asked."))).otherwise(F.concat(F.lit("**"), F.col("source"), F.lit("**")))
    return rows.select("doc_id", reply.parsed(raw).alias("r")).select("doc_id", "r.*")


@query("""SELECT item_id, 'TEXTO ORIGINAL (en):' || chr(10) || '<original>' || chr(10) || CASE WHEN item_id % 3 = 0 THEN '[VACÍO]' ELSE trim(text, ' ' || chr(10)) END || chr(10) || '</original>' || chr(10) || chr(10) || 'TRADUCCIÓN EXISTENTE (es):' || chr(10) || '<traduccion_existente>' || chr(10) || trim(text, ' ' || chr(10)) || chr(10) || '</traduccion_existente>' AS payload FROM benchmark""")
def q_fix_payload(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.fix_payload(F.when(F.col("item_id") % 3 == 0, F.lit("  ")).otherwise(F.col("text")), F.col("text"), "en", "es").alias("payload"))


@query("""SELECT n_nationkey, 'Translate the passage from en to es.' || chr(10) || chr(10) || 'Voice: ' || lower(n_name) || chr(10) || chr(10) || 'Decisions:' || chr(10) || '- ' || n_name || chr(10) || '- keep' || chr(10) || chr(10) || 'Glossary:' || chr(10) || '- ' || n_name || ': ' || n_regionkey || chr(10) || chr(10) || 'Characters:' || chr(10) || 'none' || chr(10) || chr(10) || 'Last scene: this is the beginning' || chr(10) || chr(10) || 'Answer with a JSON object: {"translation": text, "confidence": 0 to 1, "notes": text}.' AS prompt FROM nation""")
def q_prompt_render(spark, sf_dir):
    name = F.col("n_name")
    p = prompts.prompt("translate", "en", "es", F.lower(name), F.array(name, F.lit("keep")), F.create_map(name, F.col("n_regionkey").cast("string")), F.create_map().cast("map<string,string>"), F.lit(""))
    return table(spark, sf_dir, "nation").select("n_nationkey", p.alias("prompt"))


_CLEAN = "CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(left({t}, {n} - 1)) || '…' END"
_SPACED = r"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
_DECIDED = lambda t: f"{{{{'t': {_CLEAN.format(t=_SPACED.format(t=t), n=220)}}}}}".replace("{{", "{").replace("}}", "}")
_KEYED = r"regexp_replace(regexp_replace(lower(trim({t})), '\s+', ' ', 'g'), '[^\pL\pN_ ]+', '', 'g')"
_NEW = "CASE WHEN d{i}.k <> '' AND len(list_filter({held}, lambda e: e.k = d{i}.k OR list_contains(sim, d{i}.k || chr(1) || e.k))) = 0 THEN list_append({held}, d{i}) ELSE {held} END"
FOLD_MEMORY_SQL = f"""
v AS ({ORACLES["q_voice"]}),
n0 AS (SELECT conv_id, turn, role, text, regexp_extract(text, '[\\pL]{{4,}}') AS w FROM conversations),
n1 AS (SELECT *, upper(w[1]) || lower(w[2:]) AS name, {_CLEAN.format(t=_SPACED.format(t="'Mantener el tono de ' || role"), n=220)} AS t1, {_CLEAN.format(t=_SPACED.format(t="'Adaptar ' || left(text, 40)"), n=220)} AS t2 FROM n0),
n2 AS (SELECT *, first_value(name) OVER (PARTITION BY conv_id ORDER BY turn) AS opening, {{'t': t1, 'k': {_KEYED.format(t="t1")}}} AS d1, {{'t': t2, 'k': {_KEYED.format(t="t2")}}} AS d2, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
        CASE WHEN turn % 2 = 0 THEN '{L.GENERIC}' ELSE 'papel ' || role END AS what, length(name) BETWEEN 2 AND 80 AND regexp_full_match(name, '[A-Za-zÁÉÍÓÚÑáéíóúñ'' -]+') AND {FOLDED_SQL.format('name')} NOT IN ({quoted(L.NO_CHARACTER)}) AND regexp_matches(name, '^\\p{{Lu}}') AS valid FROM n1),
keys AS (SELECT conv_id, d1.k AS x FROM n2 UNION SELECT conv_id, d2.k FROM n2),
pairs AS (SELECT DISTINCT p.x AS a, q.x AS b FROM keys p JOIN keys q ON p.conv_id = q.conv_id AND p.x <> q.x AND 2.0 * least(length(p.x), length(q.x)) >= {L.SIMILAR} * (length(p.x) + length(q.x))),
{SIMILAR_SQL},
near AS (SELECT coalesce(list(a || chr(1) || b), []) AS sim FROM scored WHERE score >= {L.SIMILAR}),
rows_ AS (SELECT n2.*, v.voice AS said, sim FROM n2 JOIN v USING (conv_id, turn), near),
st AS (SELECT conv_id, 0::BIGINT AS k, -1::BIGINT AS turn, '{L.DEFAULT_VOICE}' AS voice, []::STRUCT(t VARCHAR, k VARCHAR)[] AS decs, []::STRUCT(name VARCHAR, what VARCHAR)[] AS chars, []::STRUCT(name VARCHAR, what VARCHAR)[] AS terms, '' AS scene FROM (SELECT DISTINCT conv_id FROM conversations)
       UNION ALL
       SELECT conv_id, k, turn, voice, decs2[-18:] AS decs,
              CASE WHEN NOT valid THEN left_ WHEN len(list_filter(left_, lambda c: c.name = nm)) = 0 THEN list_append(left_, {{'name': nm, 'what': what}}) ELSE list_transform(left_, lambda c: CASE WHEN c.name = nm AND c.what = '{L.GENERIC}' AND what <> '{L.GENERIC}' THEN {{'name': nm, 'what': what}} ELSE c END) END,
              CASE WHEN w = '' OR len(list_filter(terms, lambda c: c.name = nm)) > 0 THEN terms ELSE list_append(terms, {{'name': nm, 'what': role}}) END, scene
       FROM (SELECT *, {_NEW.format(i=2, held="decs1")} AS decs2 FROM (
         SELECT r.conv_id, r.k, r.turn, r.name AS nm, r.what, r.w, r.role, r.valid AND r.w <> '' AS valid, r.d2, r.sim, s.terms, CASE WHEN trim(r.said) <> '' THEN trim(r.said) ELSE s.voice END AS voice,
                CASE WHEN r.turn % 3 = 2 THEN list_filter(s.chars, lambda c: c.name <> r.opening) ELSE s.chars END AS left_, {_NEW.format(i=1, held="s.decs").replace("d1.", "r.d1.").replace(", d1)", ", r.d1)").replace("(sim,", "(r.sim,")} AS decs1,
                CASE WHEN r.text <> '' THEN {_CLEAN.format(t=_SPACED.format(t="r.text"), n=420)} ELSE s.scene END AS scene
         FROM st s JOIN rows_ r ON r.conv_id = s.conv_id AND r.k = s.k + 1)))
SELECT conv_id, turn, voice, [d.t FOR d IN decs] AS decisions, list_sort([c.name || '=' || c.what FOR c IN chars]) AS characters, list_sort([c.name || '=' || c.what FOR c IN terms]) AS glossary, scene AS last_scene FROM st WHERE k > 0
"""


@query("WITH RECURSIVE " + FOLD_MEMORY_SQL)
def q_memory_fold(spark, sf_dir):
    """Each turn names its first long word, decides two things, and each third turn rejects the conversation's first name."""
    rows = table(spark, sf_dir, "conversations")
    name = F.initcap(F.regexp_extract("text", r"[\p{L}]{4,}", 0))
    rows = rows.withColumn("name", name).withColumn("opening", F.first("name").over(W.partitionBy("conv_id").orderBy("turn")))
    none = F.create_map().cast("map<string,string>")
    some = lambda what: F.when(F.col("name") != "", F.create_map(F.col("name"), what)).otherwise(none)
    said = F.concat("text", F.lit(" y yo me fui; él dijo que su casa está aquí y nos miró."))
    updates = rows.select(
        "conv_id", F.col("turn"), T.voice(said, F.lit("")).alias("voice"), some(F.col("role")).alias("glossary"), some(F.when(F.col("turn") % 2 == 0, F.lit(L.GENERIC)).otherwise(F.concat(F.lit("papel "), "role"))).alias("characters"),
        F.array(F.concat(F.lit("Mantener el tono de "), "role"), F.concat(F.lit("Adaptar "), F.left("text", F.lit(40)))).alias("decisions"), F.col("text").alias("last_scene"),
        F.when(F.col("turn") % 3 == 2, F.array("opening")).otherwise(F.array().cast("array<string>")).alias("rejected"),
    )
    told = lambda c: F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias(c)
    return memory.fold(updates, "conv_id", "turn").select("conv_id", "turn", "voice", "decisions", told("characters"), told("glossary"), "last_scene")


@query("""SELECT n_nationkey, lower(n_name) AS folded, regexp_replace(regexp_replace(lower(trim(n_name)), '[^\\w\\s-]', '', 'g'), '\\s+', '_', 'g') AS slug FROM nation""".replace("\\\\", "\\"))
def q_slug(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.folded(F.col("n_name")).alias("folded"), T.slug(F.col("n_name")).alias("slug"))


@query(f"""WITH w AS (SELECT DISTINCT regexp_extract(text, '[\\pL]+') AS name FROM documents)
SELECT name, length(name) BETWEEN 2 AND 80 AND regexp_full_match(name, '[A-Za-zÁÉÍÓÚÑáéíóúñ'' -]+') AND {FOLDED_SQL.format('name')} NOT IN ({quoted(L.NO_CHARACTER)}) AND regexp_matches(name, '^\\p{{Lu}}') AS valid FROM w""")
def q_valid_names(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.regexp_extract("text", r"[\p{L}]+", 0).alias("name")).distinct()
    return names.select("name", T.valid_name(F.col("name")).alias("valid"))


@query(r"SELECT doc_id, CASE WHEN length(c) <= 220 THEN c ELSE rtrim(left(c, 219)) || '…' END AS clean, regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[^\pL\pN_ ]+', '', 'g') AS key FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)")
def q_decision_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cleaned_decision(F.col("text")).alias("clean"), T.decision_key(F.col("text")).alias("key"))


@query("SELECT s.conv_id, s.turn, coalesce(d.text, '') AS draft FROM conversations s LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') d USING (conv_id, turn) WHERE s.role = 'user'")
def q_draft_join(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    draft = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("draft"))
    return rows.where("role = 'user'").join(draft, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("draft", F.lit("")).alias("draft"))


@query(f"""WITH RECURSIVE {ALIGN_SQL}, s AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user')
SELECT a.conv_id AS book_id, CAST(a.k - 1 AS INTEGER) AS book_index, {_PIECE} AS original, s.text AS source FROM a JOIN s USING (conv_id, k)""")
def q_fix_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "book_id")
    index = (F.row_number().over(W.partitionBy("book_id").orderBy("turn")) - 1).alias("book_index")
    source = rows.where("role = 'user'").select("book_id", index, F.col("text").alias("original"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    return assemble.fix_chunks(source, rows.groupBy("book_id").agg(parts.alias("sections"))).select("book_id", "book_index", "original", "source")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn)) * 100.0::DOUBLE / count(*) OVER (PARTITION BY conv_id)) AS INTEGER) AS percent FROM conversations")
def q_progress(spark, sf_dir):
    w = W.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", state.progress(F.row_number().over(w.orderBy("turn")), F.count("*").over(w)).alias("percent"))


@query(f"""SELECT n_nationkey, n_nationkey % 5 <> 0 AS readable, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN '{L.DEFAULT_VOICE}' ELSE lower(n_name) END AS voice,
CASE WHEN n_nationkey % 5 >= 2 THEN [n_name, 'keep'] WHEN n_nationkey % 5 = 1 THEN [] END AS decisions, CASE WHEN n_nationkey % 5 >= 2 THEN n_regionkey::VARCHAR END AS entry FROM nation""")
def q_memory_json(spark, sf_dir):
    name, kind = F.col("n_name"), F.col("n_nationkey") % 5
    none = F.create_map().cast("map<string,string>")
    whole = F.struct(F.lower(name).alias("voice"), F.array(name, F.lit("keep")).alias("decisions"), F.create_map(name, F.col("n_regionkey").cast("string")).alias("glossary"), none.alias("characters"), F.lit("").alias("last_scene"))
    raw = F.when(kind == 0, F.lit("{bad")).when(kind == 1, F.lit('{"last_scene": "x"}')).otherwise(memory.to_json(whole))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", memory.of_json(raw).alias("m"))
    return rows.select("n_nationkey", F.col("m").isNotNull().alias("readable"), "m.voice", "m.decisions", F.try_element_at("m.glossary", F.col("n_name")).alias("entry"))


@query(f"""WITH v AS (SELECT n_nationkey AS book_id, CASE WHEN n_nationkey % 3 = 0 THEN '{{"voice": "v"}}' ELSE '{{bad' END AS memory, (n_nationkey % 3) + 1 AS version FROM nation WHERE n_nationkey % 3 < 2)
SELECT book_id, memory, version::INTEGER AS version FROM v UNION ALL
SELECT n_nationkey, '{memory.BASE_JSON}', CASE WHEN n_nationkey % 3 = 1 THEN 3 ELSE 1 END FROM nation WHERE n_nationkey % 3 <> 0""")
def q_base_memory(spark, sf_dir):
    kind = F.col("n_nationkey") % 3
    books = table(spark, sf_dir, "nation").withColumn("book_id", F.col("n_nationkey"))
    versions = books.where(kind < 2).select("book_id", F.when(kind == 0, F.lit('{"voice": "v"}')).otherwise(F.lit("{bad")).alias("memory"), (kind + 1).alias("version"))
    return memory.based(versions, books)


@query(f"""WITH c AS (SELECT DISTINCT source, lang || doc_id % 7 AS name FROM documents WHERE doc_id % 2 = 0),
k AS (SELECT source, lang || doc_id % 7 AS name, max(CASE WHEN doc_id % 6 = 0 THEN '{L.GENERIC}' ELSE 'a known one' END) AS what FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2)
SELECT source, bool_or(what IS NULL OR what = '{L.GENERIC}') AS force FROM c LEFT JOIN k USING (source, name) GROUP BY source""")
def q_forced_extraction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("name", F.concat("lang", (F.col("doc_id") % 7).cast("string")))
    known = docs.where("doc_id % 3 = 0").groupBy("source", "name").agg(F.max(F.when(F.col("doc_id") % 6 == 0, F.lit(L.GENERIC)).otherwise(F.lit("a known one"))).alias("what"))
    return memory.unenriched(docs.where("doc_id % 2 = 0").select("source", "name").distinct(), known, "source")


@query(f"""WITH v AS ({ORACLES["q_voice"]}), s AS (SELECT *, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '{L.DEFAULT_VOICE}' ELSE 'rich' END AS so_far FROM v)
SELECT conv_id, turn, CASE WHEN so_far <> 'rich' THEN voice END AS voice FROM s""")
def q_local_update(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("said", F.concat("text", F.lit(" y yo me fui; él dijo que su casa está aquí y nos miró.")))
    so_far = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.lit(L.DEFAULT_VOICE)).otherwise(F.lit("rich"))
    return rows.select("conv_id", "turn", memory.local_voice(T.voice(F.col("said"), so_far), so_far).alias("voice"))


@query("SELECT n_nationkey, coalesce(avg(length(s_name || s_suppkey)), 0.0)::DOUBLE AS avg_chars, coalesce(max(length(s_name || s_suppkey)), 0)::INTEGER AS max_chars FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey % 4 <> 1) ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def q_prompt_sizes(spark, sf_dir):
    prompts_ = table(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 1").select(F.col("s_nationkey").alias("n_nationkey"), F.concat("s_name", F.col("s_suppkey").cast("string")).alias("prompt"))
    return assemble.prompt_sizes(prompts_, table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")


@query("""WITH p AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT a.conv_id, CAST(a.k AS INTEGER) AS page, a.text AS original, b.text AS translation FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.k = b.k AND a.role = 'user' AND b.role = 'assistant'""")
def q_page_translations(spark, sf_dir):
    side = lambda role: table(spark, sf_dir, "conversations").where(F.col("role") == role).select("conv_id", "turn", "text")
    return assemble.paged(side("user"), side("assistant"), "conv_id", "turn")


@query("""SELECT n_name AS name, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS INTEGER) AS place FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_7', 'NATION_11') AND n_nationkey % 2 = 1""")
def q_model_adapters(spark, sf_dir):
    configs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("priority"), F.col("n_nationkey").alias("seq"), F.when(F.col("n_nationkey") % 2 == 1, "key").alias("api_key"))
    return routing.adapters(configs, ["NATION_1", "NATION_2", "NATION_7", "NATION_11"]).select("name", "place")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), u AS (SELECT event_type AS model, sum(CASE WHEN CAST(ts AS DATE) = CAST(now AS DATE) THEN CAST(floor(value) AS BIGINT) END) AS used, max(CASE WHEN value > 100 THEN ts END) AS failed, any_value(now) AS now FROM events, n GROUP BY event_type)
SELECT model AS name, coalesce(used, 0) < 600 AND (failed IS NULL OR now >= failed + INTERVAL 300 SECOND) AS available FROM u""")
def q_available_models(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "ts", F.floor("value").cast("long").alias("tokens"), (F.col("value") > 100).alias("failed"))
    now = F.lit(events.agg(F.max("ts")).first()[0])  # one value
    models = events.select("name").distinct().withColumn("daily_token_limit", F.lit(600))
    return routing.available(models, events, now).select("name", "available")


@query("""SELECT conv_id AS book_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS book_index, 'done' AS status, 0.9::DOUBLE AS confidence, trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) AS translated FROM conversations""")
def q_offline_run(spark, sf_dir):
    """One wave of a run with the offline model, which answers with what it is given."""
    index = (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("book_index")
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), index, F.col("text").alias("original"))
    return pipeline.answered(chunks, pipeline._latest(spark, None), pipeline.offline).select("book_id", "book_index", "status", "confidence", "translated")
