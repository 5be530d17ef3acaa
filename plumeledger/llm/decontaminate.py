"""Benchmark decontamination by winnowing.

Words are hashed, runs of K words (k-grams) are hashed, and of every SPAN - K + 1 neighbouring k-grams the least is
kept as a fingerprint (the last of equal ones). Two texts that share SPAN words in a row share the least k-gram there,
so the join of fingerprints misses no shared span; each hit is then extended in both directions to the whole shared
run, word by word, and counts if it covers a window.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumeledger.llm.shared import WordHashes, in_blocks, mix, with_columns_of, written

SPAN = 13
K = 8
#: Benchmark bytes up to which its index goes to every worker; larger ones are dealt with the documents' fingerprints.
BROADCAST_BYTES = 32 << 20

_WORD = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Byte table: A-Z to a-z; every ASCII byte but letters and digits to a space; bytes of other characters stay.
_TABLE = bytes(ord(chr(i).lower()) if i < 128 and chr(i).lower() in _WORD else i if i >= 128 else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text as the contract has them, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def kgram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = mix(x + h[i : i + n])
    return x


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: in each window the least k-gram, of equal ones the last."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, window):
        x = grams[i : i + n]
        less = x <= best
        best[less] = x[less]
        at[less] = i
    return np.unique(at + np.arange(n))


class BenchmarkIndex:
    """Fingerprints of benchmark items, their words, and the short items by length."""

    def __init__(self, items: list[tuple[str, str | None]], span: int = SPAN, k: int = K):
        self.span, self.k, self.hashes = span, k, WordHashes()
        self.items, self.words, self.prints, self.short = [], [], {}, {}
        for item_id, text in items:
            w = words(text)
            if not w:
                continue
            n = len(self.items)
            self.items.append(item_id)
            self.words.append(w)
            h = self.hashes.array(w)
            if len(w) < span:
                self.short.setdefault(len(w), {}).setdefault(int(kgram_hashes(h, len(w))[0]), []).append(n)
            else:
                g = kgram_hashes(h, k)
                for p in winnow(g, span - k + 1).tolist():
                    self.prints.setdefault(int(g[p]), []).append((n, p))
        self.sorted = np.array(sorted(self.prints), np.uint64)
        self.short_sorted = {m: np.array(sorted(x), np.uint64) for m, x in self.short.items()}

    def hits(self, w: list[bytes], row_positions: list[int], grams: np.ndarray, covered: np.ndarray, found: set[int]) -> None:
        """Extend the fingerprint hits at some positions of the words w; marks covered words and finds items."""
        done: dict[tuple[int, int], int] = {}  # item and diagonal: end of the run already extended there
        for p in row_positions:
            for n, q in self.prints[int(grams[p])]:
                if p < done.get((n, p - q), -1):
                    continue
                v = self.words[n]
                if w[p : p + self.k] != v[q : q + self.k]:
                    continue
                a, b, end, stop = p, p + self.k, min(len(w), p - q + len(v)), max(0, p - q)
                d = p - q
                while b < end and w[b] == v[b - d]:
                    b += 1
                while a > stop and w[a - 1] == v[a - 1 - d]:
                    a -= 1
                done[(n, d)] = b
                if b - a >= self.span:
                    covered[a:b] = True
                    found.add(n)

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """The number of words, which of them are hit, and the item ids of each text."""
        all_words = [words(t) for t in texts]
        lengths = np.array([len(w) for w in all_words], np.int64)
        ends = np.cumsum(lengths)
        h = np.fromiter((x for w in all_words for x in map(self.hashes.__getitem__, w)), np.uint64, int(ends[-1]) if len(ends) else 0)
        out = [(int(n), np.zeros(n, bool), set()) for n in lengths]
        rows = np.repeat(np.arange(len(lengths)), lengths)
        grams = kgram_hashes(h, self.k)
        hit_rows: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}
        if len(self.sorted) and len(grams):
            window = self.span - self.k + 1
            n = len(grams) - window + 1
            if n > 0:
                # The least k-gram of a window is a fingerprint of the text; those of the index are sought among them.
                keep = np.zeros(len(grams), bool)
                keep[winnow(grams, window)] = True
                # A window over the border of two texts may keep more, never less, and the check below is exact.
                cand = np.flatnonzero(keep)
                cand = cand[cand + self.k <= ends[rows[cand]]]
                i = np.minimum(np.searchsorted(self.sorted, grams[cand]), len(self.sorted) - 1)
                for p in cand[self.sorted[i] == grams[cand]].tolist():
                    hit_rows.setdefault(int(rows[p]), ([], []))[0].append(p)
        for m, keys in self.short_sorted.items():
            g = kgram_hashes(h, m)
            if not len(g):
                continue
            i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for p in np.flatnonzero((keys[i] == g) & (np.arange(len(g)) + m <= ends[rows[: len(g)]])).tolist():
                hit_rows.setdefault(int(rows[p]), ([], []))[1].append((p, m))
        for r, (places, short) in hit_rows.items():
            start, w = int(ends[r] - lengths[r]), all_words[r]
            covered, found = out[r][1], set()
            own = grams[start : int(ends[r])]
            self.hits(w, [p - start for p in places], own, covered, found)
            for p, m in short:
                for n in self.short[m].get(int(kgram_hashes(h[p : p + m], m)[0]), ()):
                    if w[p - start : p - start + m] == self.words[n]:
                        covered[p - start : p - start + m] = True
                        found.add(n)
            out[r][2].update(self.items[n] for n in found)
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id as string (null counts as '') and text; rows of one id are parts of that item."""
    return benchmark.select(F.coalesce(F.col("`item_id`").cast("string"), F.lit("")).alias("item_id"), F.col("`text`").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (all columns) with n_words, n_hit, n_items, item_ids, hit_spans and contaminated.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. hit_spans: first word and word past the end of each hit run. The
    benchmark's size is measured: up to broadcast_bytes its index goes to each worker; a larger one is cut into blocks
    by item, every document is held against one block after the other, and hits are united. Null and empty texts
    have no words and are clean; empty items give no windows; an empty benchmark leaves every document clean.
    Repeated documents are judged each. Columns of docs that have the name of a result column are replaced.
    """
    b = _items(benchmark)
    n_bytes = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_bytes // broadcast_bytes))
    names = ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")
    got = docs.drop(*[c for c in docs.columns if c.lower() in names])
    for i in range(blocks):
        items = b.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()  # broadcast_bytes or so
        got = _scan_block(got, [tuple(r) for r in items], span, k)
        if i < blocks - 1:
            got = written(got, "contamination")
    lengths = F.aggregate(F.col("hit_spans"), F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    got = got.withColumn("n_hit", lengths).withColumn("n_items", F.size("item_ids").cast("long"))
    return got.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


_INDEX: dict[str, BenchmarkIndex] = {}
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_FIELDS = T.StructType().add("n_words", "long").add("item_ids", T.ArrayType(T.StringType())).add("hit_spans", T.ArrayType(T.StructType().add("start", "long").add("stop", "long")))


def _scan_block(docs: DataFrame, items: list[tuple], span: int, k: int) -> DataFrame:
    """docs with n_words, item_ids and hit_spans; what those have from earlier blocks is united with this block's."""
    own = [c for c in docs.columns if c not in _FIELDS.names]
    before = len(own) < len(docs.columns)
    sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def scan(batches):
        if key not in _INDEX:
            _INDEX.clear()
            _INDEX[key] = BenchmarkIndex(sent.value, span, k)
        index = _INDEX[key]
        for b in in_blocks(batches, 400):
            got = index.scan(b.column("text").to_pylist())
            if before:
                for (n, covered, found), spans, ids in zip(got, b.column("hit_spans").to_pylist(), b.column("item_ids").to_pylist()):
                    found.update(ids)
                    for x in spans:
                        covered[x["start"] : x["stop"]] = True
            more = [
                pa.array([n for n, _, _ in got], pa.int64()),
                pa.array([sorted(x) for _, _, x in got], pa.list_(pa.string())),
                pa.array([_runs(x) for _, x, _ in got], _SPANS),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *more], names=[*own, *_FIELDS.names])

    return docs.mapInArrow(scan, T.StructType([*(docs.schema[c] for c in own), *_FIELDS]))


def _runs(covered: np.ndarray) -> list[dict]:
    if not covered.any():
        return []
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]


def op8_decontaminate(spark, sf_dir) -> DataFrame:
    """Every document of the table against the whole benchmark."""
    docs = with_columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    got = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return got.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
