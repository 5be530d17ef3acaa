"""Language-model scoring with an Elias-Fano n-gram trie of two levels, memory-mapped.

Level 1 is the vocabulary: the words' 64-bit hashes in ascending order, so a word's id is its rank, in Elias-Fano form, with
counts. Level 2 has the bigrams, ordered by (context id, word id), in shards; a shard has monotone pointers from its
contexts to their successors (Elias-Fano), the successors' ids made monotone by their context's base (Elias-Fano), and a
byte each for the smoothed probability, as an index to a codebook. A bigram is looked up by a successor search
within its context's range.

P(w | c) = (n(c, w) + MU * P(w)) / (n(c) + MU), a Dirichlet prior around P(w), which is the absolutely discounted count of w;
the discounted mass is that of the unknown word. Only contexts' counts weigh the back-off, so unseen bigrams need
no entry, and the probabilities of all words and the unknown one sum to one in each context.

Files are written to the shared folder by the tasks that make them and mapped by the tasks that score; nothing of the
model but one row a shard goes through the driver.
"""

from __future__ import annotations

import io
import mmap
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeledger.llm.shared import WordHashes, file_system, importable, in_blocks, put_file, shared_dir, with_columns_of, written

MU = 30.0
VOCAB_SHARD = 500_000
BIGRAM_SHARD = 2_000_000
END = b" "  # no word has a space
_U = np.uint64
_ALL = (1 << 64) - 1


def tokens(text: str | None) -> list[bytes]:
    """A-Z lowered; words are what ASCII white space parts; then one end."""
    return [*(text or "").encode().lower().split(), END]


class EliasFano:
    """A monotone sequence of unsigned integers: low bits packed, high bits in unary; arrays may be memory-mapped."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.l, self.low, self.high = n, low_bits, low, high
        self.ones_before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.zeros_before = np.arange(len(high) + 1, dtype=np.int64) * 64 - self.ones_before

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        l = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high_at = (values >> _U(l)).astype(np.int64) + np.arange(n)
        size = (universe >> l) + n + 2
        bits = np.zeros(-(-size // 64) * 8, np.uint8)
        np.bitwise_or.at(bits, high_at >> 3, (1 << (high_at & 7)).astype(np.uint8))
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if l and n:
            v = values & _U((1 << l) - 1)
            at = np.arange(n, dtype=np.int64) * l
            word, off = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, v << off)
            over = (off.astype(np.int64) + l) > 64
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (_U(64) - off[over]))
        return cls(n, l, low, bits.view("<u8"))

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        word, off = at >> 6, (at & 63).astype(np.uint64)
        x = self.low[word] >> off
        y = np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return (x | y) & _U((1 << self.l) - 1)

    def _place_of_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros_before, k, side="right") - 1
        left = k - self.zeros_before[word]
        x = ~self.high[word]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & _U((1 << width) - 1)).astype(np.int64)
            up = left >= c
            left = np.where(up, left - c, left)
            at += up * width
            x = np.where(up, x >> _U(width), x)
        return word * 64 + at

    def bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry with high part h or more, and the first beyond h."""
        h = h.astype(np.int64)
        start = np.zeros(len(h), np.int64)
        some = h > 0
        start[some] = self._place_of_zero(h[some] - 1) - (h[some] - 1)
        return start, self._place_of_zero(h) - h

    def find(self, values: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, or -1; the search for the successor stays within [first, stop) where given."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        at, end = self.bucket(values >> _U(self.l))
        if first is not None:
            at, end = np.maximum(at, first), np.minimum(end, stop)
        low = values & _U((1 << self.l) - 1)
        lo, hi = at.copy(), np.maximum(at, end)
        live = np.flatnonzero(lo < hi)
        while len(live):  # entries of one bucket ascend by their low bits
            mid = (lo[live] + hi[live]) >> 1
            less = self.low_of(mid) < low[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        out = np.full(len(values), -1, np.int64)
        some = np.flatnonzero(lo < end)
        hit = some[self.low_of(lo[some]) == low[some]]
        out[hit] = lo[hit]
        return out

    def arrays(self):
        return struct.pack("<qq", self.n, self.l), self.low, self.high


def _dump(*items) -> bytes:
    """Arrays and byte strings, each with its length, aligned to eight bytes."""
    out = io.BytesIO()
    for x in items:
        raw = x.tobytes() if isinstance(x, np.ndarray) else x
        out.write(struct.pack("<q", len(raw)) + raw + b"\0" * (-len(raw) % 8))
    return out.getvalue()


class _Mapped:
    """The items of a file of _dump(), memory-mapped where the folder is a local mount, else read once."""

    def __init__(self, folder: str, name: str):
        fs, root = file_system(folder)
        if fs.type_name == "local":
            with open(f"{root}/{name}", "rb") as f:
                self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with fs.open_input_stream(f"{root}/{name}") as f:
                self.data = f.read()
        self.at = 0

    def next(self, kind) -> np.ndarray:
        n = struct.unpack_from("<q", self.data, self.at)[0]
        x = np.frombuffer(self.data, kind, n // np.dtype(kind).itemsize, self.at + 8)
        self.at += 8 + n + -n % 8
        return x

    def elias_fano(self) -> EliasFano:
        n, l = self.next("<i8")
        return EliasFano(int(n), int(l), self.next("<u8"), self.next("<u8"))


class Vocabulary:
    """Level 1 over all its shards (ranges of the hash): id, count and probability of words."""

    def __init__(self, folder: str, manifest: list[tuple[int, int, int, int]], total: int, discount: float):
        """manifest: (shard, words before, words, count) of each shard in order; shards are equal ranges of the hash."""
        self.folder, self.n_shards = folder, len(manifest)
        self.before = [m[1] for m in manifest]
        self.size = sum(m[2] for m in manifest)
        self.total, self.discount = total, discount
        self.step = -(-(1 << 64) // self.n_shards)
        self.empty = [m[2] == 0 for m in manifest]
        self.open: dict[int, tuple[EliasFano, np.ndarray]] = {}
        self.unknown = discount * self.size / total if self.size else 1.0

    def _shard(self, s: int):
        if s not in self.open:
            f = _Mapped(self.folder, f"words-{s:06d}")
            self.open[s] = f.elias_fano(), f.next("<u4"), dict(zip(f.next("<u4").tolist(), f.next("<i8").tolist()))
        return self.open[s]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of word hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes // _U(self.step)).astype(np.int64) if self.n_shards > 1 else np.zeros(len(hashes), np.int64)
        for s in np.unique(shard).tolist():
            if self.empty[s]:
                continue
            at = np.flatnonzero(shard == s)
            ef, n, large = self._shard(s)
            got = ef.find(hashes[at] - _U(s * self.step))
            ok = got >= 0
            ids[at[ok]] = got[ok] + self.before[s]
            c = n[got[ok]].astype(np.int64)
            for i in np.flatnonzero(c == 0xFFFFFFFF):
                c[i] = large[int(got[ok][i])]
            counts[at[ok]] = c
        return ids, counts

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, (counts - self.discount) / max(self.total, 1), self.unknown)


class _Words:
    """Ids and counts of words, looked up in batches; keeps a bounded number of words, each a place in two arrays."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000):
        self.vocabulary, self.limit, self.hashes = vocabulary, limit, WordHashes(0)
        self._forget()

    def _forget(self) -> None:
        self.place, self.ids, self.counts = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        new = list(set(words).difference(self.place))
        if new:
            if len(self.place) + len(new) > self.limit:
                self._forget()
                new = list(set(words))
            ids, counts = self.vocabulary.lookup(self.hashes.array(new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.ids[at], self.counts[at]


def _training(docs: DataFrame) -> DataFrame:
    return docs.where((F.crc32(F.col("doc_id").cast("string")) % 7 != 2) | F.col("doc_id").isNull())


def build_vocabulary(docs: DataFrame, folder: str) -> tuple:
    """Write level 1 from the training documents; returns what Vocabulary() takes."""

    def count(batches):
        hashes, c, n = WordHashes(0), Counter(), 0
        for b in in_blocks(batches, 1000):
            for t in b.column("text").to_pylist():
                c.update(tokens(t))
            if len(c) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(hashes.array(list(c)).view(np.int64)), pa.array(list(c.values()), pa.int64())], names=["h", "n"])
                c = Counter()
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(hashes.array(list(c)).view(np.int64)), pa.array(list(c.values()), pa.int64())], names=["h", "n"])

    counts = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = written(counts, "lm-words")
    v = counts.count()
    shards = max(1, -(-v // VOCAB_SHARD))
    step = -(-(1 << 64) // shards)

    def write(key, table):
        s = key[0].as_py()
        h, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(h)
        h, n = h[order] - _U(s * step), n[order]
        large = np.flatnonzero(n >= 0xFFFFFFFF)
        ef = EliasFano.build(h, min(step, _ALL))
        data = _dump(*ef.arrays(), np.minimum(n, 0xFFFFFFFF).astype("<u4"), large.astype("<u4"), n[large].astype("<i8"))
        put_file(folder, f"words-{s:06d}", lambda out: out.write(data))
        return pa.table({"shard": [s], "n": [len(n)], "total": [int(n.sum())], "once": [int((n == 1).sum())], "twice": [int((n == 2).sum())]})

    # The unsigned hash over the step: of a negative long 2^64 must be added first.
    unsigned = F.when(F.col("h") >= 0, F.col("h").cast("decimal(20,0)")).otherwise(F.col("h").cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)"))
    shard = F.floor(unsigned / F.lit(str(step)).cast("decimal(20,0)")).cast("long") if shards > 1 else F.lit(0).cast("long")
    made = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(write, "shard long, n long, total long, once long, twice long")
    rows = {r["shard"]: r for r in written(made, "lm-manifest").collect()}  # a row for half a million words
    manifest, before = [], 0
    for s in range(shards):
        n = rows[s]["n"] if s in rows else 0
        manifest.append((s, before, n, rows[s]["total"] if s in rows else 0))
        before += n
    once, twice = (sum(r[k] for r in rows.values()) for k in ("once", "twice"))
    return folder, manifest, sum(m[3] for m in manifest), once / (once + 2 * twice) if once else 0.5


def _bounds(vocabulary: tuple) -> np.ndarray:
    """First (context, word) keys of the bigram shards: equal shares of the tokens by vocabulary shard, words taken as evenly spread."""
    _, manifest, total, _ = vocabulary
    shards = max(1, -(-total // BIGRAM_SHARD))
    out, size = [0], sum(m[2] for m in manifest)
    for i in range(1, shards):
        out.append(int(size * i / shards) << 32)
    return np.array(sorted(set(out)), np.uint64)


def build_bigrams(docs: DataFrame, vocabulary: tuple) -> list[tuple[int, int]]:
    """Write level 2; returns (first key, shard) of the shards that have bigrams.

    A shard is a range of context ids; ids are ranks of hashes, so shards hold like numbers of contexts. Tasks combine their
    counts before the shuffle, so a context with a great share of all tokens costs its distinct successors alone.
    """
    folder = vocabulary[0]
    bounds = _bounds(vocabulary)

    def count(batches):
        vocab = Vocabulary(*vocabulary)
        words, press = _Words(vocab), zstandard.ZstdCompressor(level=1)

        def flush(keys):
            k, n = np.unique(np.concatenate(keys), return_counts=True)
            cuts = np.append(np.searchsorted(k, bounds), len(k))
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for i in range(int(a), int(b), 1 << 20):
                    part, m = k[i : min(b, i + (1 << 20))], n[i : min(b, i + (1 << 20))]
                    planes = np.diff(part, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([press.compress(planes)]), pa.array([press.compress(m.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())])], names=["shard", "keys", "counts"])

        held, size = [], 0
        for b in in_blocks(batches, 500):
            ids = [END]
            for t in b.column("text").to_pylist():
                ids += tokens(t)
            i, _ = words.of(ids)
            keys = (i[:-1].astype(np.uint64) << _U(32)) | i[1:].astype(np.uint64)
            held.append(keys)
            size += len(keys)
            if size > 3_000_000:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def build(key, table):
        s = key[0].as_py()
        z = zstandard.ZstdDecompressor()
        keys, counts = [], []
        for k, n in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
            keys.append(np.cumsum(np.frombuffer(z.decompress(k), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64))
            counts.append(np.frombuffer(z.decompress(n), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))
        k, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.diff(k, prepend=k[0] ^ _U(1)))
        k, n = k[first], np.add.reduceat(n, first)
        vocab = Vocabulary(*vocabulary)
        counts_of = _counts_by_id(vocab)
        context, word = (k >> _U(32)).astype(np.int64), (k & _U(0xFFFFFFFF)).astype(np.int64)
        p = (n + MU * vocab.probability(counts_of(word))) / (counts_of(context) + MU)
        logs = np.log10(p)
        # Half the codebook follows the values' frequency, half is even over their range, which bounds every error.
        book = np.unique(np.concatenate([np.quantile(logs, np.linspace(0, 1, 128)), np.linspace(logs.min(), logs.max(), 128)]))
        code = np.clip(np.searchsorted((book[1:] + book[:-1]) / 2, logs), 0, len(book) - 1).astype(np.uint8)
        names, start = np.unique(context, return_index=True)
        base = np.repeat(np.arange(len(names)), np.diff(np.append(start, len(k))))
        level = EliasFano.build(base.astype(np.uint64) * _U(vocab.size) + word.astype(np.uint64), max(1, len(names) * vocab.size))
        pointers = EliasFano.build(np.append(start, len(k)), len(k) + 1)
        contexts = EliasFano.build((names - names[0]).astype(np.uint64), int(names[-1] - names[0]) + 1)
        data = _dump(struct.pack("<qq", int(names[0]), int(names[-1] - names[0]) + 1), *contexts.arrays(), *pointers.arrays(), *level.arrays(), code, book.astype("<f8"))
        put_file(folder, f"bigrams-{s:06d}", lambda out: out.write(data))
        return pa.table({"shard": [s], "n": [len(k)]})

    made = docs.mapInArrow(count, "shard long, keys binary, counts binary").groupBy("shard").applyInArrow(build, "shard long, n long")
    return sorted((int(bounds[r["shard"]]), r["shard"]) for r in written(made, "lm-bigrams").collect())


def _counts_by_id(vocab: Vocabulary):
    """Counts of word ids, from the shards' mapped counts."""
    before = np.array(vocab.before, np.int64)

    def of(ids: np.ndarray) -> np.ndarray:
        shard, out = np.searchsorted(before, ids, side="right") - 1, np.zeros(len(ids), np.int64)
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            _, n, large = vocab._shard(s)
            c = n[ids[at] - before[s]].astype(np.int64)
            for i in np.flatnonzero(c == 0xFFFFFFFF):
                c[i] = large[int(ids[at][i] - before[s])]
            out[at] = c
        return out

    return of


class Bigrams:
    """Level 2: smoothed log10 probabilities of seen bigrams, by shard."""

    def __init__(self, vocabulary: Vocabulary, shards: list[tuple[int, int]]):
        self.vocab, self.first = vocabulary, np.array([s[0] for s in shards], np.uint64)
        self.shards, self.open = [s[1] for s in shards], {}

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """NaN where a bigram (of known ids) was not seen."""
        key, back = np.unique((context.astype(np.uint64) << _U(32)) | word.astype(np.uint64), return_inverse=True)
        out = np.full(len(key), np.nan)
        if len(self.first):
            cuts = np.append(np.searchsorted(key, self.first), len(key))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    if i not in self.open:
                        f = _Mapped(self.vocab.folder, f"bigrams-{self.shards[i]:06d}")
                        self.open[i] = *f.next("<i8").tolist(), f.elias_fano(), f.elias_fano(), f.elias_fano(), f.next(np.uint8), f.next("<f8")
                    base, span, contexts, pointers, level, code, book = self.open[i]
                    part = key[a:b]
                    # keys ascend, so each context is looked up once, with the range of its successors
                    starts = np.flatnonzero(np.diff(part >> _U(32), prepend=_U(_ALL)))
                    c = (part[starts] >> _U(32)).astype(np.int64) - base
                    at = np.full(len(c), -1, np.int64)
                    inside = np.flatnonzero((c >= 0) & (c < span))
                    at[inside] = contexts.find(c[inside].astype(np.uint64))
                    has = np.flatnonzero(at >= 0)
                    many = np.diff(np.append(starts, len(part)))
                    first, stop = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
                    first[has], stop[has] = _access(pointers, at[has]), _access(pointers, at[has] + 1)
                    at, first, stop = np.repeat(at, many), np.repeat(first, many), np.repeat(stop, many)
                    known = np.flatnonzero(at >= 0)
                    r, lo, hi, w = at[known], first[known], stop[known], part & _U(0xFFFFFFFF)
                    got = level.find(r.astype(np.uint64) * _U(self.vocab.size) + w[known], lo, hi)
                    ok = got >= 0
                    out[a + known[ok]] = book[code[got[ok]]]
        return out[back]


def _access(ef: EliasFano, i: np.ndarray) -> np.ndarray:
    """The i-th values: the place of the i-th one of the high bits gives the high part."""
    word = np.searchsorted(ef.ones_before, i, side="right") - 1
    left, x, at = i - ef.ones_before[word], ef.high[word].copy(), np.zeros(len(i), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(x & _U((1 << width) - 1)).astype(np.int64)
        up = left >= c
        left = np.where(up, left - c, left)
        at += up * width
        x = np.where(up, x >> _U(width), x)
    high = word * 64 + at - i
    return (high << ef.l) + ef.low_of(i).astype(np.int64)


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2; rows of null doc_id train and are not held out. Null
    and empty texts are one end token. Repeated rows count each. Without training tokens every word is unknown, with
    probability 1. Words are known by a 64-bit hash. doc_id may be of any whole-number type and comes back as long.
    """
    importable(docs.sparkSession)
    d = with_columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    train = _training(d)
    vocabulary = build_vocabulary(train, shared_dir(d.sparkSession, "lm"))
    shards = build_bigrams(train, vocabulary) if vocabulary[2] else []
    total = vocabulary[2]

    def run(batches):
        vocab = Vocabulary(*vocabulary)
        words, bigrams = _Words(vocab), Bigrams(vocab, shards)
        size = vocab.size
        for b in in_blocks(batches, 1500):
            texts = [tokens(t) for t in b.column("text").to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            flat = [END]
            for t in texts:
                flat += t
            ids, counts = words.of(flat)
            starts = np.cumsum(lengths) - lengths
            w, c, context, context_count = ids[1:], counts[1:], ids[:-1], counts[:-1]
            base = np.log10((c + 1) / (total + size + 1))
            weight = np.where(context >= 0, MU / (context_count + MU), 1.0)
            logs = np.log10(weight * vocab.probability(c))
            both = np.flatnonzero((w >= 0) & (context >= 0))
            seen = bigrams.log10(context[both], w[both])
            ok = ~np.isnan(seen)
            logs[both[ok]] = seen[ok]
            add = lambda x: np.add.reduceat(x, starts)
            columns = [pa.array(lengths), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(texts), total, np.int64)), pa.array(add(base)), pa.array(add(logs))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    got = d.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_ngram_trie(spark, sf_dir) -> DataFrame:
    """Every document of the table."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
