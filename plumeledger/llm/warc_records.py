"""WARC archives written from pages and read back as a chunked record table.

A page's record is `response` with the html as payload, or `revisit`, which names the response with the same payload
and carries none itself. Reading gives rows (record, chunk number, bytes) of bounded size, each with the payload bytes
and the SHA-1 of the record's bytes up to its end, so that no record has to fit into memory at once; the last chunk of a record has the
whole payload's digest.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeledger.llm.shared import file_system, in_blocks, put_file, shared_dir, with_columns_of, written

CHUNK = 65_536
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
MAX_HEADER = 1 << 20

CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far string, last boolean, payload_bytes long, payload_digest string, archive string"


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html (null: empty), digest, n_bytes and refers_to (null for responses).

    Of pages with equal payloads of `least` bytes or more, that with the largest page_id is the response; the others
    revisit it. Only (digest, page_id) is grouped, combined before it is shuffled; only digests that occur twice are
    joined back, and a digest that many pages share is split by the adaptive join. Rows of one page_id and payload are
    all responses if that page_id is the largest. A null page_id never is the largest of several, unless all are null.
    """
    p = with_columns_of(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.octet_length("html").cast("long"))
    many = (
        p.where(F.col("n_bytes") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("many_digest"), "response_id")
    )
    joined = p.join(many.hint("merge"), (p.digest == many.many_digest) & (p.n_bytes >= least), "left")
    other = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select("page_id", "url", "html", "digest", "n_bytes", F.when(other, F.col("response_id")).alias("refers_to"))


def _header(kind: str, page_id, url, n_bytes: int, digest: str, refers_to) -> bytes:
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "Content-Type": "text/html; charset=utf-8",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(n_bytes),
    }
    if url is not None:
        head["WARC-Target-URI"] = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    if refers_to is not None:
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head["Content-Length"] = str(n_bytes if refers_to is None else 0)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode()


def write_warc(decided: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the rows of revisits() as archives of one gzip member a record; returns a row (name, n_records) for each archive."""

    def write(batches):
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        n, name = 0, f"pages-{TaskContext.get().partitionId():07d}.warc.gz"

        def records(out):
            nonlocal n

            def rows():
                yield first
                yield from batches

            for b in in_blocks(rows(), 200):
                for page_id, url, html, digest, n_bytes, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    kind = "response" if refers_to is None else "revisit"
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(z.compress(_header(kind, page_id, url, n_bytes, digest, refers_to)))
                    for i in range(0, len(html) if refers_to is None else 0, CHUNK):  # no copy of the whole payload
                        out.write(z.compress(html[i : i + CHUNK].encode()))
                    out.write(z.compress(b"\r\n\r\n"))
                    out.write(z.flush())
                    n += 1

        put_file(folder, name, records)
        yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [n]})

    columns = with_columns_of(decided, "page_id", "url", "html", "digest", "n_bytes", "refers_to")
    return columns.mapInArrow(write, "name string, n_records long")


class _Members(io.RawIOBase):
    """The bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, raw):
        self.raw, self.z, self.left = raw, None, b""

    def readable(self):
        return True

    def readinto(self, into):
        while True:
            data = self.left or self.raw.read(CHUNK)
            if not data:
                return 0
            if self.z is None:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, len(into))
            self.left = self.z.unconsumed_tail
            if self.z.eof:
                self.left, self.z = self.z.unused_data, None
            if got:
                into[: len(got)] = got
                return len(got)


def _id(text: str):
    value = text.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def read_chunks(stream, chunk: int = CHUNK):
    """(headers, chunk number, bytes, SHA-1 so far, is last) of every record in an open archive; holds one chunk at a time."""
    f = io.BufferedReader(_Members(stream), CHUNK)
    while True:
        line = f.readline(MAX_HEADER)
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not start with its version")
        head = {}
        while (line := f.readline(MAX_HEADER)).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        left, number, sha = int(head["content-length"]), 0, hashlib.sha1()
        while True:
            data = f.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("an archive ends inside a record")
            left -= len(data)
            sha.update(data)
            yield head, number, data, sha, left == 0
            number += 1
            if not left:
                break


def read_warc(archives: DataFrame, folder: str, chunk: int = CHUNK, keep_bytes: bool = True) -> DataFrame:
    """The chunked record table of the archives named in column `name`.

    One row a chunk; every record has at least one, if empty then of no bytes. payload_bytes and payload_digest are of
    the full payload and stand on a record's last chunk: for a response as counted while it streamed, and checked
    against the header; for a revisit, which has no payload of its own, as its header states. sha1_so_far is of the record's
    bytes up to the chunk's end.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def read(batches):
        for b in batches:
            for name in b.column("name").to_pylist():
                fs, root = file_system(folder)
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    seen = 0
                    for head, number, data, sha, last in read_chunks(f, chunk):
                        seen = len(data) + (seen if number else 0)
                        total = digest = None
                        kind, stated = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        if last:
                            total, digest = (seen, sha.hexdigest()) if kind == "response" else (int(head["warc-payload-length"]), stated)
                            if digest != stated:
                                raise ValueError("a payload's digest is not the one its header states")
                        url, to = head.get("warc-target-uri"), head.get("warc-refers-to")
                        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        rows.append((_id(head["warc-record-id"]), url, kind, to and _id(to), number, data if keep_bytes else None, seen, sha.hexdigest(), last, total, digest, name))
                        held += len(data) * keep_bytes + 400
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=SCHEMA)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(n, "name").mapInArrow(read, CHUNKS)


SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary())]
    + [("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string())]
)


def op10_warc_chunks(spark, sf_dir) -> DataFrame:
    """Every page's record, written and read back: the last chunk of each record."""
    folder = shared_dir(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = written(write_warc(revisits(pages), folder), "warc-archives")
    table = read_warc(archives, folder, keep_bytes=False)
    return table.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"))
