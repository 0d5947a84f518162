"""Line dedup: a segment-partition edit join, in DataFrame functions only.

Lines (parts of a text between line feeds, with something else than white space)
are first made distinct, with map-side sums, and known by 128 bits. Each with more
than ``edits`` characters is cut into ``edits + 1`` segments: two lines within
``edits`` edits share a segment. A line lists its own segments by (class of
lengths, number, content) and probes, for each class a partner's length can be in,
the substrings at which that segment can lie; the windows of Pass-Join keep these
few. Pairs that meet in a list must be near in length and in their counts of some
letters. They are verified by a banded bit-parallel edit distance on what is left
between their common beginning and end. Lines too short for segments are all
within ``edits`` of each other; with a longer one they share a character.

Linked lines form classes (connected components, with lines that are equal). The
first line of a class, by document id and place, stays; the others go.

Defined results: null text has no lines; white lines always stay and are not
counted; the number of edits is the same for lines of any length; rows with equal
id and text are one document, whose first lines stay in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, forget, keyed, same_row, written

#: Letters that are counted, modulo 32; few enough for one number.
LETTERS = "eainrstolduh"


def _class(n: Column) -> Column:
    """The shortest length of n's class of lengths: single lengths below 16, then eight classes for each doubling."""
    width = F.call_function("shiftleft", F.lit(1), F.greatest(F.floor(F.log2(n)).cast("int") - 3, F.lit(0)))
    return (n - n % width).cast("int")


def _segments(edits: int) -> Column:
    """(i, ahead, behind, shift) of all segments: they begin at ``size * ahead + n * behind + shift`` of a line of n characters.

    All lines of a class have segments of one size, those of the first half counted
    from the line's beginning, the others from its end. Of two lines within reach
    some segment i is untouched with just i edits before it, so it is shifted by at
    most i places from the beginning and by the other edits from the end.
    """
    out = []
    for i in range(edits + 1):
        ahead = 2 * i <= edits
        reach = i if ahead else edits - i
        out += [(i, i, 0, shift) if ahead else (i, i - edits - 1, 1, shift) for shift in range(-reach, reach + 1)]
    return F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(row, ("i", "ahead", "behind", "shift"), strict=True)]) for row in out])


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """(h, n, own, key): a row for each segment of a line's own class (own), and for each other substring wanted of the classes that a partner's length can have.

    Lengths and segments are rows, so a key is one short expression: written out for all of them it is too long to be compiled well.
    """
    least, n = F.greatest(F.col("n") - edits, F.lit(edits + 1)), F.col("n")
    octets = F.when(F.octet_length("line") == n, F.col("line").cast("binary"))  # of a line of single bytes: no search for a character's place
    lines = lines.where(n > edits).select("h", "line", octets.alias("octets"), "n", least.alias("first"), F.explode(F.sequence(least, n + edits)).alias("m"))
    lines = lines.select("h", "line", "octets", "n", "first", "m", _class(F.col("m")).alias("least")).where("m = first OR m = least")  # a class once
    lines = lines.select("h", "line", "octets", "n", "least", F.expr(f"least div {edits + 1}").cast("int").alias("size"), (F.col("least") == _class(n)).alias("mine"), F.explode(_segments(edits)).alias("s"))
    start = F.col("size") * F.col("s.ahead") + n * F.col("s.behind") + F.col("s.shift")
    rows = lines.select("h", "line", "octets", "n", "least", "size", (F.col("mine") & (F.col("s.shift") == 0)).alias("own"), F.col("s.i").alias("i"), start.alias("start"))
    rows = rows.where("start >= 0 AND start + size <= n")
    part = lambda c: F.substring(c, F.col("start") + 1, F.col("size"))
    content = F.when(F.col("octets").isNotNull(), part(F.col("octets"))).otherwise(part(F.col("line")).cast("binary"))
    return rows.select("h", "n", "own", F.xxhash64("least", "i", content).alias("key"))


def _characters(lines: DataFrame) -> DataFrame:
    return lines.select("h", F.explode(F.array_distinct(F.split("line", ""))).alias("key"))


def _letters(line: Column) -> Column:
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft((count % 32).cast("long"), 5 * k))
    return out


def _letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of the distance of two lines: the letters that the one, or the other, has more of."""
    more, less = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        x = (F.shiftright(a, 5 * k).bitwiseAND(31) - F.shiftright(b, 5 * k).bitwiseAND(31) + 16).bitwiseAND(31) - 16
        more, less = more + F.greatest(x, F.lit(0)), less + F.greatest(-x, F.lit(0))
    return F.greatest(more, less)


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning, by halving."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= most) & (F.substring(a, F.lit(1), (at + step).cast("int")) == F.substring(b, F.lit(1), (at + step).cast("int"))), at + step).otherwise(at))


def _common_end(a: Column, b: Column) -> Column:
    """Length of the common end; the texts are turned once."""
    return _bound(F.struct(F.reverse(a).alias("a"), F.reverse(b).alias("b")), lambda t: _common(t["a"], t["b"]))


#: The value of a band that has no way back under the limit.
_LOST = 1 << 20


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once: inside lambdas nothing else keeps an expression from being repeated."""
    return F.transform(F.array(value), f)[0]


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings, bit-parallel in a band of 2 * edits + 1 diagonals; more than ``edits`` if it is more.

    Bit k of a column's vectors is row ``i - edits + k``. The value followed is
    the band's lowest row, along the diagonal until it is a's last, then along it.
    """
    given = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("m"), F.length(b).alias("n"))
    # bound as a lambda's variable, so that no step splits again
    return F.transform(F.array(given), lambda g: _banded(g["x"], g["y"], g["m"], g["n"], edits))[0]


def _banded(x: Column, y: Column, m: Column, n: Column, edits: int) -> Column:
    width = 2 * edits + 1
    full = (1 << width) - 1
    bits = lambda c: c.bitwiseAND(F.lit(full))
    inverse = lambda c: c.bitwiseXOR(F.lit(full))
    on = lambda c, k: c.bitwiseAND(F.lit(1 << k)) != 0

    def step(s: Column, i: Column) -> Column:
        char = F.get(y, i - 1)
        same = F.lit(0)
        for k in range(width):
            same = same.bitwiseOR(F.when(F.coalesce(F.get(x, i - edits + k - 1) == char, F.lit(False)), F.lit(1 << k)).otherwise(0))

        def zeros(a: Column) -> Column:
            d0 = bits((a["same"].bitwiseAND(a["vp"]) + a["vp"]).bitwiseXOR(a["vp"]).bitwiseOR(a["same"]).bitwiseOR(a["vn"]))
            return _bound(F.struct(a["vp"].alias("vp"), a["vn"].alias("vn"), d0.alias("d0")), rows)

        def rows(a: Column) -> Column:
            hp, hn = a["vn"].bitwiseOR(inverse(a["d0"].bitwiseOR(a["vp"]))), a["d0"].bitwiseAND(a["vp"])
            return _bound(F.struct(hp.alias("hp"), hn.alias("hn"), a["d0"].alias("d0"), F.shiftrightunsigned(a["d0"], 1).alias("down")), moved)

        def moved(a: Column) -> Column:
            last = F.call_function("shiftleft", F.lit(1), F.greatest(m - i + edits, F.lit(0)).cast("int"))  # the bit of a's last row
            along = s["d"] + F.when(a["hp"].bitwiseAND(last) != 0, 1).otherwise(0) - F.when(a["hn"].bitwiseAND(last) != 0, 1).otherwise(0)
            d = F.when(i + edits > m, along).otherwise(s["d"] + F.when(on(a["d0"], 2 * edits), 0).otherwise(1))
            return _bound(F.struct(a["hn"].bitwiseOR(inverse(a["down"].bitwiseOR(a["hp"]))).alias("vp"), a["down"].bitwiseAND(a["hp"]).alias("vn"), d.cast("int").alias("d")), checked)

        def checked(a: Column) -> Column:
            # the least value of the band's rows; over the limit, no later one comes back under it
            value = least = a["d"]
            for k in range(2 * edits - 1, -1, -1):
                value = value - F.when(on(a["vp"], k), 1).otherwise(0) + F.when(on(a["vn"], k), 1).otherwise(0)
                least = F.least(least, value)
            d = F.when((i + edits <= m) & (a["d"] > edits) & (least > edits), F.lit(_LOST)).otherwise(a["d"])
            return F.struct(a["vp"].alias("vp"), a["vn"].alias("vn"), d.cast("int").alias("d"))

        return F.when(s["d"] >= _LOST, s).otherwise(_bound(F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), same.alias("same")), zeros))

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.least(F.lit(edits), m).cast("int").alias("d"))
    run = F.aggregate(F.sequence(F.lit(1), n), start, step)["d"]
    return F.when(F.abs(m - n) > edits, edits + 1).when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(run)


def _if_small(hashes: DataFrame, most: int = 1 << 21) -> DataFrame:
    """A written table of 64-bit hashes: broadcast up to a number of rows (2 Mi: 16 MB and as much again for the hash table), beyond it joined by a shuffle."""
    return F.broadcast(hashes) if hashes.count() <= most else hashes


def edit_links(lines: DataFrame, edits: int) -> DataFrame:
    """lines: (node, line), equal ones any number of times. The pairs (a, b) of nodes within ``edits`` edits; of lines of at most ``edits`` characters, all within reach of each other, those with the least node."""
    if not 0 <= edits <= 12:
        raise ValueError("edits: 0 to 12")
    lines = lines.select("node", "line", F.length("line").alias("n"), F.xxhash64("line").alias("h"))
    keys = _keys(lines, edits)
    # first the lists in which a line can meet another, by sums; then their rows; letters are counted of their lines only, and then pairs are made
    lists = written(keys.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("h"))).alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key"), "line-lists")
    met = written(keys.join(_if_small(lists), "key", "left_semi").distinct(), "line-keys")
    few = written(lines.where(F.col("n") <= 2 * edits).distinct(), "line-few")
    tiny, beyond = few.where(F.col("n") <= edits), few.where(F.col("n") > edits)
    # lines too short for segments: a longer one within reach has at most twice as many characters as edits, one of them in common
    short = written(_characters(tiny).alias("r").join(_characters(beyond).alias("s"), F.col("r.key") == F.col("s.key")).select(F.col("r.h").alias("a"), F.col("s.h").alias("b")).distinct(), "line-short")
    wanted = met.select("h").unionAll(short.select("a")).unionAll(short.select("b")).distinct()
    wanted = written(wanted, "line-wanted")
    counted = lines.join(_if_small(wanted), "h", "left_semi").select("h", "node", "line").distinct()
    counted = written(counted.select("h", "node", "line", _letters(F.col("line")).alias("letters")), "line-letters")
    letters = met.join(counted.select("h", "letters"), "h")
    r, s = letters.where("own").alias("r"), letters.alias("s")
    on = (F.col("r.key") == F.col("s.key")) & (F.col("r.h") < F.col("s.h")) & (F.abs(F.col("r.n") - F.col("s.n")) <= edits)
    near = r.join(s, on & (_letters_apart(F.col("r.letters"), F.col("s.letters")) <= edits)).select(F.col("r.h").alias("a"), F.col("s.h").alias("b")).unionAll(short).distinct()
    side = lambda c: counted.select(F.col("h").alias(c), F.col("node").alias(f"{c}_node"), F.col("line").alias(f"{c}_line"))
    near = near.join(side("a"), "a").join(side("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_line", "b_line")
    # tables between the steps: else the last filter moves below the joins and every value is computed again at each use
    beyond_begin = F.expr("substring(a_line, begin + 1) AS a_rest"), F.expr("substring(b_line, begin + 1) AS b_rest")
    ahead = written(near.withColumn("begin", _common(F.col("a_line"), F.col("b_line"))).select("a", "b", *beyond_begin), "line-texts")
    back = _common_end(F.col("a_rest"), F.col("b_rest"))
    cut = lambda c: F.expr(f"substring({c}_rest, 1, length({c}_rest) - back) AS {c}_rest")
    near = written(ahead.withColumn("back", back).select("a", "b", cut("a"), cut("b")), "line-rests")
    links = written(near.where(banded_distance(F.col("a_rest"), F.col("b_rest"), edits) <= edits).select("a", "b"), "line-links")
    forget(lists, met, short, wanted, counted, ahead, near)
    first = F.lit(tiny.agg(F.min("node")).first()[0]).cast(tiny.schema["node"].dataType)  # one value
    among = tiny.where(F.col("node") != first).select(first.alias("a"), F.col("node").alias("b"))
    return links.unionAll(among)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2) -> DataFrame:
    """One row per input row: id, n_lines, n_removed, kept_text (what is left, white lines included)."""
    docs = keyed(df, id_col, text_col)
    lines = docs.select("_id", "_key", F.posexplode(F.split("_text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    # one pass splits the texts, and no shuffle has lines that meet no other
    places = written(lines.select("_id", "_key", "pos", F.unhex(F.md5("line")).alias("node"), "line"), "places")
    classes = written(components(edit_links(places.select("node", "line"), edits)), "classes")
    places = places.join(classes, "node", "left").select("_id", "_key", "pos", F.coalesce("component", "node").alias("c"))
    firsts = places.groupBy("c").agg(F.min(F.struct("_id", "_key", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1").select("c", "f")
    gone = places.join(firsts, "c").where(~F.struct("_id", "_key", "pos").eqNullSafe(F.col("f")))
    gone = gone.groupBy("_id", "_key").agg(F.collect_set("pos").alias("gone"))
    gone = gone.hint("shuffle_hash")  # the texts are not sorted
    out = docs.join(gone, same_row(docs, gone), "left").select(docs["_id"], "_text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    parts = F.split("_text", "\n")
    stay = lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone")), lambda i: F.get(p, i))
    kept = F.when(F.size("gone") == 0, F.coalesce("_text", F.lit(""))).otherwise(_bound(parts, lambda p: F.array_join(stay(p), "\n")))
    count = F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(r"\S"))), F.lit(0))
    return out.select(F.col("_id").alias(id_col), F.when(F.col("_text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), kept.alias("kept_text"))
