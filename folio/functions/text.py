"""Text functions: Column in, Column out. All are built-in expressions that Catalyst can plan and push."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio import lexicons as L


def bound(value: Column, f) -> Column:
    """f of a value that is computed once: as a lambda's variable nothing repeats its expression."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def est_tokens(text: Column) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(F.size(words(F.coalesce(text, F.lit("")))) * F.lit(1.3)).cast("int")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def truncated(text: Column, most: int) -> Column:
    clean = collapse(text)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.left(clean, F.lit(most - 1))), F.lit("…")))


def folded(text: Column) -> Column:
    """Lower case without accents, as the compatibility decomposition gives it (all scripts below U+2000; a ligature stays one sign), stripped."""
    return F.trim(F.lower(F.translate(text, L.ACCENTED, L.PLAIN)))


def valid_name(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    parts = words(n)
    single = (F.size(parts) == 1) & folded(n).isin(L.NO_CHARACTER)
    return F.length(n).between(2, 80) & n.rlike(r"^[A-Za-zÁÉÍÓÚÑáéíóúñ' -]+$") & ~single & F.exists(parts, lambda w: w.rlike(r"^\p{Lu}"))


def decision_key(decision: Column) -> Column:
    """What two decisions are compared by: lower case, single spaces, no punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(decision, F.lit("")))), r"(?U)\s+", " "), r"[^\p{L}\p{N}_ ]+", "")


def cleaned_decision(decision: Column) -> Column:
    return truncated(decision, L.MOST_DECISION_CHARS)


def scene_digest(text: Column, most: int = L.DIGEST_CHARS) -> Column:
    """The first two sentences, at most ``most`` characters."""
    clean = collapse(text)
    two = F.trim(F.array_join(F.slice(F.split(clean, r"(?<=[.!?])\s+"), 1, 2), " "))
    short = F.when(F.length(two) > most, F.concat(F.rtrim(F.left(two, F.lit(most - 1))), F.lit("…"))).otherwise(two)
    return F.when(clean == "", F.lit(L.NO_SCENE)).otherwise(short)


def voice(text: Column, fallback: Column | None = None) -> Column:
    """Person by distinct cue words, tense by occurrences of verbs."""
    given = F.concat(F.lit(" "), F.lower(text), F.lit(" "))

    def told(low: Column) -> Column:
        hits = lambda cues: sum((F.contains(low, F.lit(c)).cast("int") for c in cues), F.lit(0))
        count = lambda verbs: F.regexp_count(low, F.lit(r"(?<![\p{L}\p{N}_])(" + "|".join(verbs) + r")(?![\p{L}\p{N}_])"))
        person = F.when(hits(L.FIRST_PERSON) >= F.greatest(F.lit(2), hits(L.THIRD_PERSON) + 1), "primera persona").otherwise("tercera persona")
        tense = F.when(count(L.PAST) >= count(L.PRESENT), "tiempo pasado").otherwise("tiempo presente")
        return F.concat(F.lit("narrador en "), person, F.lit(", "), tense)

    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", fallback if fallback is not None else F.lit(None)).otherwise(bound(given, told))


def style_decisions(notes: Column, most: int = 5) -> Column:
    parts = F.transform(F.split(F.coalesce(notes, F.lit("")), r"\."), strip)
    with_keyword = F.filter(parts, lambda p: F.exists(F.array(*[F.lit(k) for k in L.STYLE_KEYWORDS]), lambda k: F.contains(F.lower(p), k)))
    return F.slice(with_keyword, 1, most)


def speaks_of_news(notes: Column) -> Column:
    """Whether notes name something worth extracting."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    found = F.lit(False)
    for k in L.GATE_KEYWORDS:
        found |= F.contains(low, F.lit(k))
    return found


def status_of(confidence: Column) -> Column:
    return F.when(confidence >= L.SURE, "done").otherwise("flagged")


def title_of(text: Column, stem: Column, most: int = 10) -> Column:
    """The first line without leading #, if it has one to ``most`` words and no full stop at the end; else the stem."""
    first = strip(F.regexp_replace(strip(F.split(strip(text), "\n")[0]), "^#+", ""))
    n = F.size(words(first))
    return F.when((n > 0) & (n <= most) & ~first.endswith("."), first).otherwise(stem)


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"(?U)[^\w\s-]", ""), r"(?U)\s+", "_")


def html_to_text(html: Column) -> Column:
    """Some block tags become line feeds, other tags go, nine entities are decoded in order, blanks are squeezed."""
    out = F.regexp_replace(html, r"(?i)<(p|br|div|h[1-6]|li|tr|blockquote)[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for entity, char in L.ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n"))


def valid_language(code: Column) -> Column:
    return code.rlike(r"^[\p{L}-]{1,10}$") & code.rlike(r"\p{L}")


def matches(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= text.rlike(p)
    return out


def fix_payload(source: Column, draft: Column, source_lang: str, target_lang: str) -> Column:
    full = lambda t: F.coalesce(F.nullif(strip(F.coalesce(t, F.lit(""))), F.lit("")), F.lit(L.EMPTY))
    return F.concat(F.lit(f"TEXTO ORIGINAL ({source_lang}):\n<original>\n"), full(source), F.lit("\n</original>\n\n"), polish_payload(draft, target_lang))


def polish_payload(draft: Column, target_lang: str) -> Column:
    full = F.coalesce(F.nullif(strip(F.coalesce(draft, F.lit(""))), F.lit("")), F.lit(L.EMPTY))
    return F.concat(F.lit(f"TRADUCCIÓN EXISTENTE ({target_lang}):\n<traduccion_existente>\n"), full, F.lit("\n</traduccion_existente>"))


def fix_key(source_hash: Column, draft_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("fix"), source_hash, draft_hash), 256)


def polish_key(target_lang: str, draft_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("fix_style"), F.lit(target_lang.lower()), draft_hash), 256)
