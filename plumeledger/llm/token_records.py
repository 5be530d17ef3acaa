"""Token ids as length-delimited binary records with an offset index beside them.

A shard is a file of records in ascending doc_id order. A record is the framing that TFRecord readers know:
8 bytes length, 4 bytes masked CRC-32C of the length, the payload, 4 bytes masked CRC-32C of the payload, all
little-endian. The payload is 8 bytes doc_id (signed; null sets flag byte 1), the flag byte, and the ids as
unsigned integers of 16 bits, or of 32 if the
tokenizer has ids beyond 16 bits (flag byte 2 is set then). Beside `shard-N.rec` lies `shard-N.idx`: 24 bytes a record (offset, bytes,
doc_id), so a reader can visit records in any order without a scan.
"""

from __future__ import annotations

import array
import json
import os
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumeledger.llm.shared import by_bytes, file_system, in_blocks, put_file, shared_dir, with_columns_of, written

END_ID = 2
CACHE_WORDS = 1_600_000
LEARN_WORDS = 100
#: Bytes of text that are cut and put together at once.
RUN_BYTES = 8 << 20
#: Marks that often end a word.
MARKS = ".,;:!?"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        out.append(c)
    return out


_T = _crc_table()
def crc32c(data: bytes) -> int:
    """CRC-32C of a short string, one byte at a time."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ _T[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    """Rotated right by 15 bits and offset, so that a CRC of data that holds CRCs stays sound."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def _zeros(n: int) -> np.ndarray:
    """The CRC register's 32 basis vectors after n zero bytes, as 4 tables of 256."""
    mat = [1 << i for i in range(32)]
    step = [(x >> 8) ^ _T[x & 255] for x in mat]

    def times(m, v):
        s = i = 0
        while v:
            if v & 1:
                s ^= m[i]
            v >>= 1
            i += 1
        return s

    out, sq = mat, step
    while n:
        if n & 1:
            out = [times(sq, x) for x in out]
        sq = [times(sq, x) for x in sq]
        n >>= 1
    tables = np.zeros((4, 256), np.uint32)
    for j in range(4):
        for b in range(256):
            v = 0
            for i in range(8):
                if b >> i & 1:
                    v ^= out[8 * j + i]
            tables[j, b] = v
    return tables


_WIDE = 64
_PAIRS = np.array([_T[v & 255] for v in range(65536)], np.uint32)  # what two bytes add to an empty register
_PAIRS = (_PAIRS >> np.uint32(8)) ^ np.array(_T, np.uint32)[((_PAIRS ^ (np.arange(65536, dtype=np.uint32) >> np.uint32(8))) & np.uint32(255))]
_PAST_WIDE = _zeros(_WIDE)


def crc32c_each(items: list[bytes]) -> np.ndarray:
    """CRC-32C of many strings of four bytes or more: pieces of 64 bytes side by side in numpy, then joined."""
    lengths = np.array([len(x) for x in items], np.int64)
    rows = -(-lengths // _WIDE)
    last = np.cumsum(rows)
    data = np.zeros(int(last[-1]) * _WIDE, np.uint8)  # each string ends on a boundary; zeros before it change nothing
    at = last * _WIDE - lengths
    view = memoryview(data)
    for x, i in zip(items, at.tolist()):
        view[i : i + len(x)] = x
    data[(at[:, None] + np.arange(4)).ravel()] ^= 255  # as a register that starts with all bits set
    words = np.ascontiguousarray(data.view("<u2").reshape(-1, _WIDE // 2).T)
    c = np.zeros(words.shape[1], np.uint32)
    for w in words:
        c = (c >> np.uint32(16)) ^ _PAIRS[(c & np.uint32(65535)) ^ w]
    order = np.argsort(-rows, kind="stable")
    first, count, out, t = (last - rows)[order], rows[order], np.zeros(len(items), np.uint32), _PAST_WIDE
    for i in range(int(count[0])):
        n = int(np.searchsorted(-count, -i))  # the strings that have an i-th piece
        x = out[:n]
        out[:n] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24] ^ c[first[:n] + i]
    back = np.empty_like(out)
    back[order] = out
    return back ^ np.uint32(0xFFFFFFFF)


class Encoder:
    """Token ids of whole texts by the tokenizers library, as little-endian unsigned integers of 16 or 32 bits.

    A byte-level tokenizer never joins what a single space between two non-spaces, or a single line feed, parts. So a
    text whose white space is all of that kind is cut there, and each piece is encoded once per worker; a run of texts is
    cut, its pieces are told apart and their ids are put together as arrays. Other texts, and those that hold an added
    token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.code = "H" if len(self.starts) <= 1 << 16 else "I"
        for t, i in vocab.items():
            self.starts[i] = t.startswith("Ġ")  # the byte-level alphabet's space
        self.newline = np.array(self._whole("\n"))
        # A space and ASCII letters are one word of the byte-level pattern and stand for themselves in its alphabet: those go to the same merges without the pattern.
        parts = json.loads(self.tok.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.letters = None
        if parts["pre_tokenizer"] == plain and parts["normalizer"] is None and parts["model"]["type"] == "BPE":
            self.letters = Tokenizer.from_str(json.dumps(parts | {"pre_tokenizer": None}))
            self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        other = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")
        self.uncut = f"\\A[ \n]|[ \n]\\z|[ \n][ \n]|[{other}]"
        self._forget()

    def _whole(self, text: str, tok=None) -> list[int]:
        return (tok or self.tok).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.places: dict[str, int] = {}  # the ids of the piece at place i are store[ends[i]:ends[i + 1]]
        self.store, self.ends = np.zeros(1 << 12, f"<{self.code}"), np.zeros(1 << 10, np.int64)

    def _add(self, pieces: list[str], ids: np.ndarray, first: np.ndarray) -> None:
        """New pieces, whose ids begin at first."""
        n = len(self.places)
        used, last = self.ends[n], n + len(pieces)
        while used + len(ids) > len(self.store):
            self.store = np.append(self.store, np.zeros_like(self.store))
        while last >= len(self.ends):
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        self.store[used : used + len(ids)] = ids
        self.ends[n + 1 : last + 1] = used + np.append(first[1:], len(ids))
        self.places.update(zip(pieces, range(n, last)))

    def _learn(self, pieces: list[str], tok=None) -> None:
        """One call for many pieces, a space before each: only a piece's first token starts with a space."""
        mark = " " if tok is None else "Ġ"
        for i in range(0, len(pieces), LEARN_WORDS):
            part = pieces[i : i + LEARN_WORDS]
            ids = np.array(self._whole(mark + (" " + mark).join(part) if tok else " " + " ".join(part), tok))
            first = np.flatnonzero(self.starts[ids])
            if len(first) != len(part):
                raise ValueError("the tokenizer joined pieces that a space parts")
            self._add(part, ids, first)

    def _learn_lines(self, pieces: list[str]) -> None:
        """Pieces with a line feed before each."""
        for i in range(0, len(pieces), LEARN_WORDS):
            part = pieces[i : i + LEARN_WORDS]
            ids = np.array(self._whole("".join(part)))
            first = np.flatnonzero(ids == self.newline[0])
            if len(self.newline) != 1 or len(first) != len(part):
                raise ValueError("the tokenizer joined pieces that a line feed parts")
            self._add(part, ids, first)

    def _learn_new(self, pieces: set[str]) -> None:
        lines, letters, ending, others = [], [], [], []
        for p in pieces:
            if p[0] == "\n":
                lines.append(p)
            elif self.letters is None or not p.isascii():
                others.append(p)
            elif p.isalpha():
                letters.append(p)
            else:
                stem = p.rstrip(MARKS)
                (ending if stem.isalpha() else others).append(p)
        # Letters and the marks after them are words of their own to the pattern.
        stems = {p: p.rstrip(MARKS) for p in ending}
        letters += set(stems.values()) - self.places.keys() - set(letters)
        self._learn(letters, self.letters)
        self._learn(others)
        self._learn_lines(lines)
        if ending:
            tails = {t: np.array(self._whole(t), self.store.dtype).tobytes() for t in {p[len(stems[p]) :] for p in ending}}
            width, at, raw = self.store.itemsize, self.places, self.store.tobytes()
            lo, hi = (self.ends[np.fromiter((at[stems[p]] + k for p in ending), np.int64, len(ending))] * width for k in (0, 1))
            each = [raw[a:b] + tails[p[len(stems[p]) :]] for p, a, b in zip(ending, lo.tolist(), hi.tolist())]
            sizes = np.array([len(x) for x in each]) // width
            self._add(ending, np.frombuffer(b"".join(each), self.store.dtype), np.cumsum(sizes) - sizes)

    def _cut_ids(self, texts: pa.LargeStringArray) -> list[bytes]:
        """The ids of texts that can be cut."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts, pieces = words.offsets.to_numpy(), words.values.dictionary_encode()
        heads = ["\n" + w for w in words.values.take(pa.array(starts[:-1])).to_pylist()]  # a text begins as a line does
        known = pieces.dictionary.to_numpy(zero_copy_only=False).tolist() + heads
        place = list(map(self.places.get, known))
        new = {p for p, k in zip(known, place) if k is None}
        if len(self.places) + 2 * len(new) > CACHE_WORDS:  # with the stems of new pieces
            self._forget()
            new, place = set(known), [None] * len(known)
        if new:
            self._learn_new(new)
            place = [self.places[p] if k is None else k for p, k in zip(known, place)]
        each = np.array(place, np.int64)
        place = each[pieces.indices.to_numpy()]
        place[starts[:-1]] = each[len(each) - len(heads) :]
        first = self.ends[place]
        n = self.ends[place + 1] - first
        first[starts[:-1]] += len(self.newline)
        n[starts[:-1]] -= len(self.newline)
        past = np.cumsum(n)
        raw = self.store[np.repeat(first - past + n, n) + np.arange(past[-1])].tobytes()
        at = (np.append(0, past[starts[1:] - 1]) * self.store.itemsize).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for part in by_bytes(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"]), "text", RUN_BYTES):
            column = part.column(0)
            whole = pc.match_substring_regex(column, self.uncut)
            for t in self.added:
                whole = pc.or_(whole, pc.match_substring(column, t))
            keep = pc.and_not(pc.not_equal(column, ""), whole)
            cut = iter(self._cut_ids(column.filter(keep)) if pc.any(keep).as_py() else [])
            for i, k in enumerate(keep.to_pylist()):
                out.append(next(cut) if k else array.array(self.code, self._whole(column[i].as_py())).tobytes())
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def frames(payloads: list[bytes]) -> list[bytes]:
    """The records of some payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    marks = [struct.pack("<I", masked(c)) for c in crc32c_each(payloads).tolist()]
    return [b"".join((h, struct.pack("<I", masked(crc32c(h))), p, m)) for h, p, m in zip(heads, payloads, marks)]


def unframed(data: bytes, places: list[tuple[int, int]]) -> list[bytes]:
    """The payloads of the records at (byte, bytes) of data, both checksums of each checked."""
    out, marks = [], []
    for at, n in places:
        length, crc = struct.unpack_from("<QI", data, at)
        if length != n - 16 or masked(crc32c(data[at : at + 8])) != crc:
            raise ValueError("the length of a record is wrong")
        out.append(data[at + 12 : at + n - 4])
        marks.append(struct.unpack_from("<I", data, at + n - 4)[0])
    if out and [masked(c) for c in crc32c_each(out).tolist()] != marks:
        raise ValueError("the checksum of a record is wrong")
    return out


def write_token_records(docs: DataFrame, tokenizer: str, folder: str, *, shards: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode each text, append end_id, and write shards of records in ascending doc_id order; returns one row a shard.

    Shards are ranges of doc_id, so one shuffle of the texts puts them in order; encoding follows it and streams.
    Null text counts as empty: its record holds end_id alone. Null doc_id sorts first. Rows of equal doc_id are all
    written, ordered by text. An empty table gives no shards. Other columns are not read.
    """
    d = with_columns_of(docs, "doc_id", "text")
    n = shards or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")).asc()]
    ordered = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        name = f"shard-{TaskContext.get().partitionId():07d}"
        enc, index, total = encoder(tokenizer), [], 0
        width, wide = (2, 0) if enc.code == "H" else (4, 2)
        end = struct.pack("<" + enc.code, end_id)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def records(out):
            nonlocal total
            at = 0

            def all_batches():
                yield first
                yield from batches

            for b in in_blocks(all_batches(), 2500):
                ids = b.column(0).to_pylist()
                raws = enc([t or "" for t in b.column(1).to_pylist()])
                for doc_id, raw, frame in zip(ids, raws, frames([struct.pack("<qB", i or 0, (i is None) + wide) + r + end for i, r in zip(ids, raws)])):
                    out.write(frame)
                    index.append((at, len(frame), doc_id or 0))
                    at += len(frame)
                    total += len(raw) // width + 1

        put_file(folder, f"{name}.rec", records)
        put_file(folder, f"{name}.idx", lambda out: out.write(np.array(index, "<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": [int(name[6:])], "name": [name], "n_docs": [len(index)], "n_tokens": [total]})

    return ordered.mapInArrow(write, "shard long, name string, n_docs long, n_tokens long")


def read_token_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, shard, offset) of written shards, records found by their offset index.

    start: ids of all documents before. manifest: the rows of write_token_records(), read from a table; the sum over
    shards runs over one row a shard.
    """
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist()):
                fs, root = file_system(folder)
                with fs.open_input_stream(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                with fs.open_input_file(f"{root}/{name}.rec") as f:
                    for i in range(0, len(index), 1000):
                        part = index[i : i + 1000]
                        base = int(part[0, 0])
                        data = f.read_at(int(part[-1].sum() - part[-1, 2]) - base, base)
                        rows = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "offset")}
                        for (at, _, doc_id), payload in zip(part.tolist(), unframed(data, [(a - base, n) for a, n, _ in part.tolist()])):
                            own, flags = struct.unpack_from("<qB", payload)
                            if own != doc_id:
                                raise ValueError("the index names another document")
                            ids = payload[9:] if flags & 2 else np.frombuffer(payload, "<u2", offset=9).astype("<u4").tobytes()
                            for k, v in zip(rows, (None if flags & 1 else own, start, len(ids) // 4, zlib.crc32(ids), at)):
                                rows[k].append(v)
                            start += len(ids) // 4
                        yield pa.RecordBatch.from_pydict(rows | {"shard": [name] * len(part)}, schema=pa.schema([(k, pa.int64()) for k in rows] + [("shard", pa.string())]))

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, offset long, shard string")


def op2_token_records(spark, sf_dir) -> DataFrame:
    """Every document of the table, encoded, written, and read back from the files."""
    import public_tokenizers

    folder = shared_dir(spark, "token-records")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = written(write_token_records(docs, public_tokenizers.path("byte_bpe_50k.json"), folder), "token-manifest")
    return read_token_records(manifest, folder)
