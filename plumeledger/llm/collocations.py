"""Phrase collocation mining with counting quotient filters.

A phrase of n words is packed into one whole number: the place of its first n-1 words among the frequent phrases of that length, and
the id of its last word. An invertible mixing of these bits spreads them evenly; the mixed number's high bits (quotient)
say where it lies in a filter and its low bits (remainder) are kept in full, so a filter is a lossless, sorted table of
counts: a bit for each quotient that occurs, a bit at the end of each quotient's run, the remainders, and counters of
one byte, with larger ones beside. Every task counts its phrases in filters, cut by the mixed number's highest bits;
filters of one cut are merged in order on one task, and those phrases that occur MIN_COUNT times stay.

A frequent phrase has only frequent parts, so length n counts only where both parts of n-1 words are frequent: exact, and the
rest is never shuffled. The text is read twice (words; ids of frequent words), lengths 2 to 5 read the ids. A task
maps words to ids and finds phrases of the lengths before by reading the frequent ones from the shared folder: 8 bytes a
phrase and a dictionary of the words, each of which occurs MIN_COUNT times or more. These grow with the corpus (at most a hundredth of its
words, in practice far less); a machine must hold them.
"""

from __future__ import annotations

import functools
import struct
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.llm.components import join_counted
from plumeledger.llm.shared import by_bytes, file_system, importable, shared_dir

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Words counted, or phrases gathered, before a task hands on what it has.
WORDS_AT_ONCE, PHRASES_AT_ONCE = 400_000, 2_000_000
#: Bytes of text that a task has in hand, and that become one row of ids.
TEXT_AT_ONCE = 4 << 20
#: Words of the corpus for each cut of a filter.
CUT_WORDS = 4_000_000
#: Salts of a language's ranking.
SALTS = 64

# --- mixing: invertible on numbers of `width` bits

_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def mixed(x: np.ndarray, width: int) -> np.ndarray:
    m, s = _mask(width), np.uint64((width + 1) // 2)
    x = (x * np.uint64(_A)) & m
    x ^= x >> s
    return (x * np.uint64(_B)) & m


def unmixed(x: np.ndarray, width: int) -> np.ndarray:
    m, s = _mask(width), np.uint64((width + 1) // 2)
    x = (x * np.uint64(pow(_B, -1, 1 << 64))) & m
    x ^= x >> s
    return (x * np.uint64(pow(_A, -1, 1 << 64))) & m


# --- filters

_HEAD = struct.Struct("<BBQQ")
_FULL = 255


def to_filter(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A counting quotient filter of distinct keys below 2**width, in ascending order. Remainders are whole bytes."""
    n = len(keys)
    size = min(-(-max(0, width - n.bit_length()) // 8), width // 8)
    q = width - 8 * size
    quotient = (keys >> np.uint64(8 * size)).astype(np.int64) if size < 8 else np.zeros(n, np.int64)
    occupied = np.zeros(1 << q, np.bool_)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, np.bool_)
    remainders = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size])
    large = counts >= _FULL
    small = np.where(large, _FULL, counts).astype(np.uint8)
    beside = counts[large].astype("<u8")
    return b"".join([_HEAD.pack(width, size, n, len(beside)), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders.tobytes(), small.tobytes(), beside.tobytes()])


def from_filter(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys ascending, counts, width) of a filter."""
    width, size, n, n_large = _HEAD.unpack_from(data)
    q, at = width - 8 * size, _HEAD.size
    parts = []
    for length in (-(-(1 << q) // 8), -(-n // 8), n * size, n, 8 * n_large):
        parts.append(np.frombuffer(data, np.uint8, length, at))
        at += length
    quotients = np.flatnonzero(np.unpackbits(parts[0], count=1 << q)).astype(np.uint64)
    ends = np.unpackbits(parts[1], count=n).astype(np.int64)
    run = np.cumsum(ends) - ends
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :size] = parts[2].reshape(n, size)
    keys = keys.view("<u8").reshape(n).astype(np.uint64)
    if size < 8 and n:
        keys |= quotients[run] << np.uint64(8 * size)
    counts = parts[3].astype(np.int64)
    counts[counts == _FULL] = parts[4].view("<u8").astype(np.int64)
    return keys, counts, width


def merged(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and summed counts of filters of one width; a stable sort of sorted runs is a merge."""
    parts = [from_filter(f) for f in filters]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts, parts[0][2]


# --- words

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BREAK, _DROP = 0, 0xFFFFFFFF


def tokens(text: bytes) -> list[bytes]:
    """Words, empty strings (to be left out), and a line feed at each end of a piece."""
    return text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


def _in_hand(batches):
    for b in batches:
        yield from by_bytes(b, "text", TEXT_AT_ONCE)


def _count_words(batches):
    counts, names = {}, ["lang", "word", "c"]

    def flush():
        for lang, c in counts.items():
            c.pop(b"", None)
            c.pop(b"\n", None)
            words = [w.decode() for w in c]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(list(c.values()), pa.int64())], names=names)
        counts.clear()

    for b in _in_hand(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            c = counts.get(lang)
            if c is None:
                c = counts[lang] = Counter()
            c.update(tokens(text))
        if sum(map(len, counts.values())) > WORDS_AT_ONCE:
            yield from flush()
    yield from flush()


def _files(folder: str):
    """Parquet files of a written folder, in order of their parts."""
    fs, root = file_system(folder)
    from pyarrow.fs import FileSelector

    for f in sorted((f.path for f in fs.get_file_info(FileSelector(root)) if f.base_name.startswith("part-")), key=lambda p: p.rsplit("/", 1)[-1]):
        yield pq.read_table(f, filesystem=fs)


@functools.lru_cache(maxsize=2)
def _dictionary(folder: str) -> tuple[dict[str, dict[bytes, int]], list[tuple[str, str]]]:
    """({language: {word: id}}, [(language, word)]); ids count from 1 in order of the files."""
    ids, words = {}, [("", "")]
    for t in _files(folder):
        for lang, word in zip(t.column("lang").to_pylist(), t.column("word").to_pylist()):
            ids.setdefault(lang, {b"": _DROP})[word.encode()] = len(words)
            words.append((lang, word))
    return ids, words


@functools.lru_cache(maxsize=8)
def _level(folder: str) -> tuple[np.ndarray, int]:
    """(mixed keys ascending, width) of the frequent phrases of one length; a phrase's id is its place, from 1."""
    rows = [r for t in _files(folder) for r in zip(t.column("cut").to_pylist(), t.column("filter").to_pylist())]
    width, keys = 64, [np.zeros(0, np.uint64)]
    for cut, data in sorted(rows, key=lambda r: r[0]["cut"]):
        k, _, w = from_filter(data)
        width = w + cut["bits"]
        keys.append(k | np.uint64(cut["cut"]) << np.uint64(w))
    return np.concatenate(keys), width


def _encode(batches, folder: str):
    ids, _ = _dictionary(folder)
    none = {b"": _DROP}
    for b in _in_hand(batches):
        parts = []
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            t = tokens(text)
            parts.append(np.fromiter(map(ids.get(lang, none).get, t, repeat(_BREAK)), np.uint32, len(t)))
            parts.append(np.zeros(1, np.uint32))
        a = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        a = a[a != _DROP]
        # of words, those with a neighbour; of breaks, one in a row
        here, before, after = a > 0, np.append(False, a[:-1] > 0), np.append(a[1:] > 0, False)
        a = a[np.where(here, before | after, before)]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["ids"])


# --- lengths


def _found(keys: np.ndarray, width: int, x: np.ndarray) -> np.ndarray:
    """Ids of packed phrases among the frequent ones, 0 for others."""
    if not len(keys):
        return np.zeros(len(x), np.uint64)
    m = mixed(x, width)
    at = np.minimum(np.searchsorted(keys, m), len(keys) - 1)
    return np.where(keys[at] == m, at + 1, 0).astype(np.uint64)


def _candidates(a: np.ndarray, levels: list[str], word_bits: int) -> np.ndarray:
    """Packed phrases of len(levels) + 2 words, at each place where both parts of one word less are frequent."""
    cur = a.astype(np.uint64)
    place = np.arange(len(a))  # where a phrase of the present length begins
    shift = np.uint64(word_bits)
    for n, folder in enumerate([*levels, None], start=2):
        cur_next = np.zeros(len(a), np.uint64)
        cur_next[place] = cur
        both = cur_next[place] > 0
        follow = place + 1
        both &= follow < len(a)
        both[both] = cur_next[follow[both]] > 0
        place = place[both]
        packed = (cur_next[place] << shift) | a[place + n - 1].astype(np.uint64)
        if folder is None:
            return packed
        cur = _found(*_level(folder), packed)
        place, cur = place[cur > 0], cur[cur > 0]
    raise AssertionError


def _count_phrases(batches, levels: list[str], word_bits: int, width: int, cut_bits: int):
    held, n, inner = [], 0, width - cut_bits

    def flush():
        if not held:
            return
        keys, counts = np.unique(mixed(np.concatenate(held), width), return_counts=True)
        held.clear()
        cuts = (keys >> np.uint64(inner)).astype(np.int64) if cut_bits else np.zeros(len(keys), np.int64)
        names, starts = np.unique(cuts, return_index=True)
        data = [to_filter(k & _mask(inner), c, inner) for k, c in zip(np.split(keys, starts[1:]), np.split(counts, starts[1:]))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["cut", "filter"])

    for b in batches:
        for ids in b.column("ids").to_pylist():
            a = np.frombuffer(ids, np.uint32)
            if len(a) > len(levels) + 1:
                held.append(_candidates(a, levels, word_bits))
                n += len(held[-1])
                if n >= PHRASES_AT_ONCE:
                    yield from flush()
                    n = 0
    yield from flush()


_CUT = pa.struct([("cut", pa.int64()), ("bits", pa.int32())])


def _merging(bits: int, min_count: int):
    """Merges the filters of one cut and keeps what occurs min_count times."""

    def merge(key, table):
        keys, c, w = merged(table.column("filter").to_pylist())
        often = c >= min_count
        rows = [{"cut": key[0].as_py(), "bits": bits}], [to_filter(keys[often], c[often], w)], [int(often.sum())]
        return pa.table([pa.array(rows[0], _CUT), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64())], names=["cut", "filter", "n"])

    return merge


def _save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    folder = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every phrase of 1 to `longest` words with f >= min_count, (lang, n) of all languages that have words).

    Text is cut into pieces and words as tokens() says; null texts have none, null languages are `und`. Repeated rows count each.
    """
    spark = docs.sparkSession
    importable(spark)
    d = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts, _ = _save(d.mapInArrow(_count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "phrases-words")
    totals, _ = _save(counts.groupBy("lang").agg(F.sum("c").alias("n")), "phrases-totals")
    vocabulary, words_at = _save(counts.where(F.col("c") >= min_count).orderBy("lang", "word"), "phrases-vocabulary")
    n_words, n_all = vocabulary.count(), totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = vocabulary.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("c").alias("f"))
    ids, _ = _save(d.mapInArrow(lambda bs: _encode(bs, words_at), "ids binary"), "phrases-ids")
    word_bits, cut_bits = max(1, n_words.bit_length()), max(0, (n_all // CUT_WORDS).bit_length())
    levels, below = [], n_words
    for n in range(2, longest + 1):
        width = below.bit_length() + word_bits
        if not below:
            break
        if width > 64:
            raise ValueError(f"{below} phrases of {n - 1} words and {n_words} words do not pack into 64 bits")
        bits, before = min(cut_bits, width - 1), list(levels)
        cuts = ids.mapInArrow(lambda bs, a=before, w=width, c=bits: _count_phrases(bs, a, word_bits, w, c), "cut long, filter binary")
        found, folder = _save(cuts.groupBy("cut").applyInArrow(_merging(bits, min_count), "cut struct<cut:long,bits:int>, filter binary, n long"), f"phrases-{n}")
        levels.append(folder)
        below = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        out = out.unionAll(found.mapInArrow(lambda bs, a=list(levels): _spell(bs, a, word_bits, words_at), "lang string, phrase string, words int, f long"))
    return _save(out, "phrases-frequent")[0], totals



def _spell(batches, levels: list[str], word_bits: int, words_at: str):
    """The words of the phrases in filters of the last of the levels, from the last word to the first."""
    _, words = _dictionary(words_at)
    low = np.uint64((1 << word_bits) - 1)
    for b in batches:
        for cut, data in zip(b.column("cut").to_pylist(), b.column("filter").to_pylist()):
            keys, counts, inner = from_filter(data)
            keys |= np.uint64(cut["cut"]) << np.uint64(inner)
            width, ends = inner + cut["bits"], []
            for folder in reversed([None, *levels[:-1]]):
                x = unmixed(keys, width)
                ends.append(x & low)
                at = x >> np.uint64(word_bits)
                if folder is not None:
                    keys, width = _level(folder)
                    keys = keys[at.astype(np.int64) - 1]
            ends.append(at)
            rows = list(zip(*(e.tolist() for e in reversed(ends))))
            phrases = pa.array([" ".join(words[i][1] for i in r) for r in rows], pa.string())
            arrays = [pa.array([words[r[0]][0] for r in rows], pa.string()), phrases, pa.array([len(levels) + 1] * len(rows), pa.int32()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "words", "f"])


# --- scores


def _run(words: str, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): candidates of 2 words or more that no longer one of equal count contains.

    A phrase's count is at least that of a longer one around it, and both of its next shorter parts have counts in
    between; so it is enough to look at those that are longer by one word. Scores are exact decimals of up to 38 digits.
    """
    frequent, totals = phrase_counts(docs, min_count, longest)
    candidates = frequent.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "words")
    cut = candidates.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _run("w", 1, F.col("k")).alias("head"), _run("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    left = frequent.select(F.col("lang").alias("lang_l"), F.col("phrase").alias("phrase_l"), F.col("f").alias("l"))
    right = frequent.select(F.col("lang").alias("lang_r"), F.col("phrase").alias("phrase_r"), F.col("f").alias("r"))
    cut = cut.join(left.hint("merge"), (F.col("lang") == F.col("lang_l")) & (F.col("head") == F.col("phrase_l")))
    cut = cut.join(right.hint("merge"), (F.col("lang") == F.col("lang_r")) & (F.col("tail") == F.col("phrase_r")))
    sizes = totals.select(F.col("lang").alias("lang_n"), "n")
    cut = join_counted(cut, sizes, F.col("lang") == F.col("lang_n"))
    score = F.expr("cast((cast(1000 as decimal(4,0)) * (cast(a as decimal(15,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as bigint)")
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"), F.first("a").alias("a"), F.first("n").alias("n"))
    longer = candidates.where("words > 2")
    parts = F.explode(F.array(_run("w", 1, F.col("words") - 1), _run("w", 2, F.col("words") - 1))).alias("part")
    held = longer.select(F.col("lang").alias("lang_p"), "a", parts).groupBy("lang_p", "part").agg(F.max("a").alias("most"))
    free = best.join(held.hint("merge"), (F.col("lang") == F.col("lang_p")) & (F.col("phrase") == F.col("part")) & (F.col("most") >= F.col("a")), "left_anti")
    return free.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def top_collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """The first `top` collocations of each language by score, count and phrase; ranked in salted parts first, so that one language is no burden to one task."""
    found = collocations(docs, min_count, longest)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    got = part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table."""
    return top_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
