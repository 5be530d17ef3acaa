"""Fuzzy line deduplication by DataFrame functions alone.

A line is normalised to its lower-case words (of scripts without spaces, characters). Equal lines are found by their hash.
Others of MIN_CHARS characters or more meet by pigeonhole blocks: the hashes of a line's word pairs, long pairs (the rare
ones) before short, are cut into overlapping runs of three, and the first BLOCKS runs are join keys. A changed word breaks the few runs that its two pairs
lie in or come to lie in; as long as one run stays whole, two lines meet. Lines of at most DROP_WORDS words, with few runs, also
have a key for each word, the hash of all others. Lines that meet are held against each other by their SimHashes (of words and word pairs, at
most MAX_BITS of 64 bits apart), then by edit similarity. Of each connected group of lines the first occurrence, by
(doc_id, line number), stays.

Blocks of the SimHash's own bits are no join keys: one changed word in ten moves some 9 of 64 bits, which leaves no block
of useful width whole, so the greater part of near copies would never meet.

A bucket of lines that share a key is not turned into all its pairs. Its lines are sorted by the pair that follows the key's
run (of leave-one-out keys, by the word left out), which puts copies side by side. Each is held against the first of the bucket,
then, where that leaves lines in different groups, against its neighbour and the shortest lines of about its length, which have least
besides what they share with the others. That joins nearly all copies, and the work grows with the lines. What a bucket still holds in
different groups and has not met is then held against each other pair by pair, in cells of CELL lines by CELL lines, so that no
link between lines of a bucket is lost and no task holds a bucket. Pairs whose letters alone ask for more edits than allowed go
before that; it loses nothing. This last step is quadratic in the unlike lines of a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.llm.components import components, join_counted
from plumeledger.llm.shared import importable, written

MIN_WORDS = 5
MIN_CHARS = 9
SIMILARITY = 0.8
BLOCKS = 8
DROP_WORDS = 12
END = 3
#: Lines of similarity 0.8 differ in some 17 bits, unlike ones in 30, give or take 4; lines of a few words in up to 27.
MAX_BITS = 24
MAX_BITS_SHORT = 30
SHORT = 80
CELL = 512
LETTERS = "abcdefghijklmnopqrstuvwxyz "

_APART = "([\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}])"


def line_words(line: Column) -> Column:
    """The lower-case runs of letters and digits of a line."""
    return F.array_remove(F.split(F.lower(line), "[^\\p{L}\\p{N}]+"), "")


def _tokens(line: Column) -> Column:
    """line_words(), but of scripts that part no words by spaces each character; only lines of long code points are looked through for them."""
    wide = F.octet_length(line) * 2 > F.length(line) * 3
    return line_words(F.when(wide, F.regexp_replace(line, _APART, " $1 ")).otherwise(line))


def simhash(words: Column) -> Column:
    """The 64-bit SimHash of an array of words: a bit is set where more than half of the words' hashes have it.

    Bits are counted in lanes of a few longs: of 8 bits for at most 63 words, of 16 up to 16,383, else of 32.
    """

    def of(width: int) -> Column:
        ones = F.lit(sum(1 << i for i in range(0, 64, width)))
        names = [f"s{j}" for j in range(width)]
        zero = F.struct(*[F.lit(0).cast("long").alias(s) for s in names])
        bit = lambda x, j: F.shiftrightunsigned(x, j).bitwiseAND(ones)
        sums = F.aggregate(F.transform(words, lambda w: F.xxhash64(w)), zero, lambda a, x: F.struct(*[(a[s] + bit(x, j)).alias(s) for j, s in enumerate(names)]))
        # With this added, a lane's bit before its last is set where more than half of the words counted.
        lift = ones * ((1 << (width - 2)) - 1 - F.floor(F.size(words) / 2))
        most = lambda a, j: F.shiftleft(bit(a[names[j]] + lift, width - 2), j)
        return F.transform(F.array(sums), lambda a: F.array(*[most(a, j) for j in range(width)]))[0]

    n = F.size(words)
    lanes = F.when(n <= 63, of(8)).when(n <= 16383, of(16)).otherwise(of(32))
    return F.aggregate(lanes, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def line_table(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, dh, pos, lh, keys) of every line that can be a duplicate; dh tells rows of one doc_id apart by text.

    lh is the hash of the line's words. With min_words 0 lines without a word, but not blank, are there too, each hashed
    as it is but for its white space. Lines under min_chars characters have no keys.
    """
    # The steps are separate selects: an expression that is used more than once is worked out once.
    t = docs.select("doc_id", F.xxhash64("text").alias("dh"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    t = t.where(F.btrim("line", F.lit(" \t\x0b\f\r")) != "")  # a test of the words here would work them out twice
    bare = F.regexp_replace("line", "\\s+", "")
    t = t.select("doc_id", "dh", "pos", "line", _tokens(F.col("line")).alias("w")).withColumn("n", F.size("w"))
    if min_words > 0:
        t = t.where(F.col("n") >= min_words)
    t = t.select(
        "doc_id", "dh", "pos", "n", F.when(F.col("n") > 0, F.xxhash64("w")).otherwise(F.xxhash64(F.lit("line"), bare)).alias("lh"),
        (F.length("line") >= min_chars).alias("long"), F.transform("w", lambda x: F.xxhash64(x).bitwiseAND(F.lit(-64)).bitwiseOR(F.least(F.length(x), F.lit(63)))).alias("h"), F.when(F.col("n") <= DROP_WORDS, F.col("w")).alias("w"),
    )
    # A word's hash ends in its length. A pair's hash begins with 127 less its length, so that long pairs come first.
    size = lambda x: x.bitwiseAND(F.lit(63))
    short = lambda x, y: F.shiftleft(127 - (size(x) + F.coalesce(size(y), F.lit(0))), 56)
    pair = lambda x, y: short(x, y).bitwiseOR(F.shiftrightunsigned(F.xxhash64(x, y), 8))
    t = t.withColumn("s", F.slice(F.sort_array(F.transform("h", lambda x, i: pair(x, F.get("h", i + 1)))), 1, BLOCKS + 3))
    t = t.withColumn("all", F.when(F.col("n") <= DROP_WORDS, F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))))
    entry = lambda key, after: F.struct(key.alias("key"), F.coalesce(after, F.lit(0)).cast("long").alias("after"))
    none = F.array().cast("array<struct<key:bigint,after:bigint>>")
    runs = F.transform(F.slice("s", 1, F.greatest(F.size("s") - 3, F.lit(0))), lambda x, i: entry(F.xxhash64(x, F.get("s", i + 1), F.get("s", i + 2)), F.get("s", i + 3)))
    # A line of a few words has fewer pairs than that: its last run ends with its last pair.
    tail = F.when(F.size("s").between(3, BLOCKS + 2), F.array(entry(F.xxhash64(F.get("s", F.size("s") - 3), F.get("s", F.size("s") - 2), F.get("s", F.size("s") - 1)), F.lit(0)))).otherwise(none)
    # The line without a word; of a word that is half the line or more, its first or last characters stay.
    total = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    left = lambda i: F.get("h", i).bitwiseXOR(F.col("all"))
    start = lambda x: F.xxhash64(F.substring(x, 1, END))
    ends = lambda x, i: F.array(entry(F.xxhash64(left(i), F.substring(x, 1, END)), F.length(x)), entry(F.xxhash64(left(i), F.substring(x, -END, END), F.lit(1)), F.length(x)))
    others = F.flatten(F.transform("w", lambda x, i: F.when(2 * F.length(x) < F.col("total"), F.array(entry(F.xxhash64(left(i), F.col("n") - 1), start(x)))).otherwise(ends(x, i))))
    t = t.withColumn("total", F.when(F.col("n") <= DROP_WORDS, total))
    few = F.when(F.col("n").between(1, DROP_WORDS), F.concat(F.array(entry(F.xxhash64("all", "n"), F.lit(0))), others)).otherwise(none)
    keys = F.when(F.col("long"), F.concat(runs, tail, few)).otherwise(none)
    return t.select("doc_id", "dh", "pos", "lh", keys.alias("keys"))


def _edit_similar(pairs: DataFrame, similarity: float, parts: tuple[int, ...] = (64, 8)) -> DataFrame:
    """Those of pairs (a, b, x, y) whose word arrays x and y, joined by spaces, are similar: their edit distance is at most (1 - similarity) of the longer.

    Words that both begin or end with add nothing to the distance, so it is that of what lies between. The verdict goes
    through explode(), as a filter would be moved below the steps and work each out wherever it is used.
    """
    joined = lambda c: F.array_join(c, " ")
    p = pairs.withColumns({"lx": F.length(joined("x")), "ly": F.length(joined("y"))})
    p = p.withColumn("most", F.floor((1 - F.lit(similarity)) * F.greatest("lx", "ly") + 1e-9).cast("int"))
    agree = lambda x, y: F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    shortest = F.least(F.size("x"), F.size("y"))
    p = p.withColumn("head", F.coalesce(F.nullif(agree("x", "y"), F.lit(0)) - 1, shortest).cast("int"))
    p = p.withColumn("tail", F.least(F.coalesce(F.nullif(agree(F.reverse("x"), F.reverse("y")), F.lit(0)) - 1, shortest), shortest - F.col("head")).cast("int"))
    rest = lambda c: F.slice(c, F.col("head") + 1, F.greatest(F.size(c) - F.col("head") - F.col("tail"), F.lit(0)))
    p = p.withColumns({"mx": rest("x"), "my": rest("y")}).withColumns({"rx": joined("mx"), "ry": joined("my")})
    # Word for word replaced, the distance is at most that of the words that differ; one pass tells. Otherwise the cost grows with the bound, and near copies are mostly nearer than they need be: smaller bounds, these parts of it, are tried first. -1 is beyond the bound.
    near = F.when(F.abs(F.col("lx") - F.col("ly")) > F.col("most"), False)  # nothing lies between on one side: a space more than the rest goes
    near = near.when(F.greatest(F.length("rx"), F.length("ry")) <= F.col("most"), True)
    apart = F.zip_with("mx", "my", lambda a, b: F.when(a == b, 0).otherwise(F.greatest(F.length(a), F.length(b))))
    near = near.when((F.size("mx") == F.size("my")) & (F.aggregate(apart, F.lit(0), lambda a, x: a + x) <= F.col("most")), True)
    for part in parts:
        near = near.when(F.expr(f"levenshtein(rx, ry, cast(most / {part} as int))") >= 0, True)
    near = near.otherwise(F.expr("levenshtein(rx, ry, most)") >= 0)
    return p.select("a", "b", F.explode(F.when(near, F.array(F.lit(True)))).alias("near")).select("a", "b")


def _texts(pairs: DataFrame, lines: DataFrame, docs: DataFrame) -> tuple[DataFrame, int]:
    """(lh, words, sim, size), written, of the lines in pairs (a, b), and a bound of its rows. lines: where a line first occurs."""
    needed = written(pairs.select(F.col("a").alias("h")).unionAll(pairs.select("b")).distinct(), "lines-needed")
    sought = needed.count()
    where = join_counted(lines, needed, lines.lh == needed.h, "left_semi", rows=sought)
    places = written(where.select("lh", F.col("first.doc_id").alias("at_id"), F.col("first.dh").alias("at_dh"), F.col("first.pos").alias("at_pos")), "lines-sought")
    with_dh = docs.select("doc_id", F.xxhash64("text").alias("dh"), "text")
    found = join_counted(with_dh, places, with_dh.doc_id.eqNullSafe(places.at_id) & (with_dh.dh == places.at_dh), rows=sought)
    words = found.select("lh", line_words(F.element_at(F.split("text", "\n"), F.col("at_pos") + 1)).alias("words"))
    pairs_of = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    features = words.select("lh", "words", F.array_distinct(F.concat("words", pairs_of)).alias("features"))
    texts = features.select("lh", "words", simhash(F.col("features")).alias("sim"), F.length(F.array_join("words", " ")).alias("size"))
    return written(texts.dropDuplicates(["lh"]), "lines-texts"), sought


def _alike(size_a: Column, sim_a: Column, size_b: Column, sim_b: Column, similarity: float) -> Column:
    """Whether two lines can be similar by their lengths, and their SimHashes are near."""
    return (F.least(size_a, size_b) >= similarity * F.greatest(size_a, size_b) - 1e-9) & (
        F.bit_count(sim_a.bitwiseXOR(sim_b)) <= F.when(F.least(size_a, size_b) < SHORT, MAX_BITS_SHORT).otherwise(MAX_BITS)
    )


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float, parts: tuple[int, ...] = (64, 8)) -> DataFrame:
    """Those of the alike pairs (a, b) of line hashes whose lines are similar."""
    x = texts.select(F.col("lh").alias("a"), F.col("words").alias("x"))
    y = texts.select(F.col("lh").alias("b"), F.col("words").alias("y"))
    return _edit_similar(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b"), similarity, parts)


def _letters(text: Column) -> Column:
    """How often each of LETTERS occurs in a text, and all other characters together."""
    counts = F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS])
    return F.concat(counts, F.array(F.length(text) - F.aggregate(counts, F.lit(0), lambda a, x: a + x)))


def _within(size_a: Column, letters_a: Column, size_b: Column, letters_b: Column, similarity: float) -> Column:
    """False only for pairs that are not similar: an edit takes one letter away at most and adds one at most."""
    apart = F.aggregate(F.zip_with(letters_a, letters_b, lambda a, b: F.abs(a - b)), F.lit(0), lambda a, x: a + x)
    return apart + F.abs(size_a - size_b) <= 2 * F.floor((1 - F.lit(similarity)) * F.greatest(size_a, size_b) + 1e-9)


def _mixed(members: DataFrame, roots: DataFrame, n_roots: int, least: int) -> DataFrame:
    """The members, with root and other, of buckets of that many lines in which a line is not in the first one's group (other).

    members (key, at, lh, hub, ...) are the lines of a bucket from its second (at 2) on.
    """
    own, first = (roots.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "lh")
    m = join_counted(join_counted(members, own, F.col("lh") == F.col("nl"), "left", rows=n_roots), first, F.col("hub") == F.col("nh"), "left", rows=n_roots)
    m = m.select(*members.columns, F.coalesce("rl", "lh").alias("root"), (F.coalesce("rl", "lh") != F.coalesce("rh", "hub")).alias("other"))
    m = written(m, "line-rooted")
    of = m.groupBy("key").agg(F.max("at").alias("n"), F.max("other").alias("any")).where((F.col("n") >= least) & F.col("any"))
    of = written(of.select(F.col("key").alias("k")), "line-mixed")
    return join_counted(m, of, F.col("key") == F.col("k"), "left_semi")


def _shortest(mixed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (lh, short) of each line and, of the bucket's lines outside the first one's group, the shortest of its band of length and of the band below."""
    step = -math.log(min(max(similarity, 0.01), 0.99))
    m = mixed.withColumn("band", F.floor(F.log(F.greatest("size", F.lit(1))) / step))
    least = m.where("other").groupBy("key", "band").agg(F.min(F.struct("size", "lh", "root")).alias("least"))
    least = written(least.select(F.col("key").alias("k"), F.col("band").alias("of"), F.col("least.lh").alias("short"), F.col("least.root").alias("short_root")), "line-shortest")
    both = m.select("key", "lh", "root", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    return join_counted(both, least, (F.col("key") == F.col("k")) & (F.col("band") == F.col("of")) & (F.col("root") != F.col("short_root"))).select("lh", "short")


def _rest(mixed: DataFrame, roots: DataFrame, n_roots: int, texts: DataFrame, met: DataFrame, similarity: float) -> DataFrame:
    """Alike pairs (a, b) of the lines that share a bucket, lie in different groups and have not been held against each other, which are in met.

    mixed (key, at, lh, hub, sim, size): lines of a bucket from its second on. All have met the first line and their neighbours, so
    buckets of four lines and more are left, and in them the lines that are not in the first one's group: each meets all others.
    """
    m = written(_mixed(mixed, roots, n_roots, 4).withColumn("cell", F.floor((F.col("at") - 2) / CELL)), "line-left")
    of = m.groupBy("key").agg(F.max("at").alias("n"), F.collect_set(F.when(F.col("other"), F.col("cell"))).alias("cells"))
    of = written(of.select(F.col("key").alias("k"), "cells", F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / CELL)).alias("all")), "line-cells")
    left = written(m.select(F.col("lh").alias("h")).distinct(), "lines-left")
    letters = join_counted(texts, left, F.col("lh") == F.col("h"), "left_semi").select(F.col("lh").alias("h"), F.array_join("words", " ").alias("text"))
    letters = written(letters.select("h", _letters(F.col("text")).alias("letters")), "line-letters")
    m = join_counted(join_counted(m, of, F.col("key") == F.col("k")), letters, F.col("lh") == F.col("h"))
    fields = ("at", "lh", "root", "other", "sim", "size", "letters")
    x = m.where("other").select("key", F.col("cell").alias("i"), F.explode("all").alias("j"), *[F.col(c).alias(f"{c}_x") for c in fields])
    y = m.select("key", F.explode("cells").alias("i"), F.col("cell").alias("j"), *[F.col(c).alias(f"{c}_y") for c in fields])
    once = ~F.col("other_y") | (F.col("at_x") < F.col("at_y"))  # of two such lines each would meet the other
    far = (F.abs(F.col("at_x") - F.col("at_y")) > 1) & (F.col("root_x") != F.col("root_y"))
    can = _alike(F.col("size_x"), F.col("sim_x"), F.col("size_y"), F.col("sim_y"), similarity) & _within(F.col("size_x"), F.col("letters_x"), F.col("size_y"), F.col("letters_y"), similarity)
    both = x.join(y.hint("merge"), ["key", "i", "j"]).where(once & far & can)
    pairs = both.select(F.least("lh_x", "lh_y").alias("a"), F.greatest("lh_x", "lh_y").alias("b")).distinct()
    seen = met.select(F.col("a").alias("ma"), F.col("b").alias("mb"))
    return join_counted(pairs, seen, (F.col("a") == F.col("ma")) & (F.col("b") == F.col("mb")), "left_anti")


def duplicate_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, dh, pos) of the lines to drop. docs: doc_id and text, without nulls in text."""
    occurrences = written(line_table(docs, min_words), "lines")
    place = F.struct("doc_id", "pos", "dh")
    lines = occurrences.groupBy("lh").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    lines = written(lines, "lines-distinct")

    # Of equal lines the first occurrence alone gives its keys; one shuffle deals them out, and the bucket's first line is its hub.
    repeated = lines.where("n > 1").select(F.col("lh").alias("again"), "first")
    keyed = join_counted(occurrences.where(F.size("keys") > 0), repeated, F.col("lh") == F.col("again"), "left")
    is_first = F.col("again").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos")) & (F.col("first.dh") == F.col("dh")))
    keys = keyed.where(is_first).select("lh", F.explode("keys").alias("k")).select("lh", "k.key", "k.after")
    w = W.partitionBy("key").orderBy("after", "lh")
    members = keys.select("key", F.row_number().over(w).alias("at"), "lh", F.first("lh").over(w).alias("hub"), F.lag("lh").over(w).alias("before")).where("before is not null")
    members = written(members, "line-members")
    ordered = lambda x: [F.least(x, "lh").alias("a"), F.greatest(x, "lh").alias("b")]
    tried = written(members.select(*ordered("hub")).where("a <> b").distinct(), "line-pairs")
    texts, n_texts = _texts(tried, lines, docs)  # a bucket's lines have all met its first
    marks = texts.select(F.col("lh").alias("h"), "sim", "size")
    of_a, of_b = (marks.select(F.col("h").alias(f"h{c}"), F.col("sim").alias(f"sim{c}"), F.col("size").alias(f"size{c}")) for c in "ab")

    def alike(pairs):
        both = join_counted(join_counted(pairs, of_a, F.col("a") == F.col("ha"), rows=n_texts), of_b, F.col("b") == F.col("hb"), rows=n_texts)
        return both.where(_alike(F.col("sizea"), F.col("sima"), F.col("sizeb"), F.col("simb"), similarity)).select("a", "b")

    tried = written(alike(tried), "line-tried")
    links = written(_similar(tried, texts, similarity), "line-links")
    roots = written(components(links), "line-roots")
    n_roots = roots.count()
    mixed = join_counted(_mixed(members, roots, n_roots, 3), marks, F.col("lh") == F.col("h"), rows=n_texts)
    mixed = written(mixed.select("key", "at", "lh", "before", "hub", "root", "other", "sim", "size"), "line-mixed-lines")
    more = mixed.where("before <> hub").select(*ordered("before")).unionAll(_shortest(mixed, similarity).select(*ordered("short")))
    more = written(more.where("a <> b").distinct(), "line-pairs")
    ra, rb = (roots.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
    apart = join_counted(join_counted(more, ra, F.col("a") == F.col("na"), "left", rows=n_roots), rb, F.col("b") == F.col("nb"), "left", rows=n_roots)
    apart = alike(apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    apart = written(join_counted(apart, tried.select(F.col("a").alias("ta"), F.col("b").alias("tb")), (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"), "line-apart")

    def linked(roots, pairs, parts):
        more = written(_similar(pairs, texts, similarity, parts), "line-links")
        return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)), "line-roots")

    if not apart.isEmpty():
        roots = linked(roots, apart, (64, 8))
        n_roots = roots.count()
    mixed = mixed.drop("before", "root", "other")
    rest = written(_rest(mixed, roots, n_roots, texts, tried.unionAll(apart), similarity), "line-rest")
    if not rest.isEmpty():
        roots = linked(roots, rest, ())  # mostly unlike: smaller bounds would be in vain
        n_roots = roots.count()

    grouped = join_counted(lines, roots, lines.lh == roots.node, "left", rows=n_roots).where("n > 1 or root is not null")
    grouped = written(grouped.select("lh", "first", F.coalesce("root", "lh").alias("root")), "line-grouped")
    keep = grouped.groupBy("root").agg(F.min("first").alias("keep")).select(F.col("root").alias("r"), "keep")
    dropped = written(grouped.join(keep.hint("merge"), F.col("root") == F.col("r")).select(F.col("lh").alias("gone"), "keep"), "line-groups")
    o = join_counted(occurrences.select("doc_id", "dh", "pos", "lh"), dropped, F.col("lh") == F.col("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("pos") == F.col("keep.pos")) & (F.col("dh") == F.col("keep.dh"))
    return o.where(~same).select("doc_id", "dh", "pos")


def line_dedup(docs: DataFrame, *, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs (all columns, a row each) with the duplicate lines taken out of text, and n_lines, n_dropped.

    Lines are what line feeds part. Lines of fewer than min_words words always stay and are never compared; with min_words 0
    only blank lines do. Null text stays null (no lines); empty text has one empty line; an empty table gives no rows. A
    document whose lines all go keeps its row with empty text. Rows of the same doc_id and text count as one document
    and get the same result; rows of null doc_id come first in order, and ties of doc_id go by line number, then by
    a hash of the text. Columns of docs that have the name of a result column are replaced.
    """
    importable(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    base = docs.select(*[F.col(f"`{c}`") for c in own])
    narrow = base.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drops = duplicate_lines(narrow, min_words=min_words, similarity=similarity)
    by_doc = drops.groupBy(F.col("doc_id").alias("drop_id"), F.col("dh").alias("drop_dh")).agg(F.collect_set("pos").alias("drop_pos"))
    by_doc = written(by_doc, "line-drops")
    on = base["doc_id"].eqNullSafe(by_doc["drop_id"]) & (F.xxhash64(F.coalesce(base["text"], F.lit(""))) == by_doc["drop_dh"])
    got = join_counted(base, by_doc, on, "left", limit=2 * 10**5)
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop_pos", i)), "\n")
    got = got.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    got = got.withColumn("n_dropped", F.when(F.col("drop_pos").isNull(), F.lit(0)).otherwise(F.size("drop_pos")).cast("long"))
    return got.withColumn("text", F.when(F.col("drop_pos").isNull(), F.col("text")).otherwise(kept)).select(*own, "n_lines", "n_dropped")


def op1_line_dedup(spark, sf_dir) -> DataFrame:
    """Every document of the table: its text without duplicate lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs.select("doc_id", "text"), min_words=0).select("doc_id", "n_lines", "n_dropped", "text")
