"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits.

Every shingle is hashed once; the hash's top bits choose a bin and the rest compete for the bin's minimum. An empty bin
takes the value of the first filled bin on a probe path of its own (an odd-step walk over all bins, the same for all
documents), which is what makes the densified estimate unbiased and low in variance. Of each minimum only the low BITS
bits are stored, so two unlike bins agree by chance with probability 2**-BITS, and likeness() corrects for that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeledger.llm.shared import WordHashes, in_blocks, mix, parts_for, shingles, with_columns_of

BINS = 256
BITS = 4
SHINGLE = 5
NO_ID = -(1 << 63)

_STEPS = mix(np.arange(1, BINS + 1, dtype=np.uint64))
_START = (_STEPS % np.uint64(BINS)).astype(np.int64)
_STEP = ((_STEPS >> np.uint64(32)) % np.uint64(BINS // 2)).astype(np.int64) * 2 + 1
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(h: np.ndarray, lengths: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Low-order bits of the densified minima, one row a text; a text without words has all 255."""
    n = len(lengths)
    x, rows = shingles(h, lengths, k)
    x = mix(x)
    at = rows * BINS + (x >> np.uint64(56)).astype(np.int64)
    least = np.full(n * BINS, _FULL, np.uint64)
    np.minimum.at(least, at, x & np.uint64((1 << 56) - 1))
    least = least.reshape(n, BINS)
    filled = least != _FULL
    r, i = np.nonzero(~filled & (lengths > 0)[:, None])
    step = 0
    while len(r):
        donor = (_START[i] + step * _STEP[i]) % BINS
        got = filled[r, donor]
        least[r[got], i[got]] = least[r[got], donor[got]]
        r, i = r[~got], i[~got]
        step += 1
    low = (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[lengths == 0] = 255
    return low


def packed(low: np.ndarray) -> list[str]:
    """Two 4-bit values a byte, in hex; the empty string for a text without words."""
    raw = ((low[:, 0::2] & 15) << 4 | (low[:, 1::2] & 15)).astype(np.uint8)
    return ["" if x[0] == 255 else b.tobytes().hex() for x, b in zip(low, raw)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, row by row, corrected for chance agreement of BITS bits."""
    none_a, none_b = a[:, 0] == 255, b[:, 0] == 255
    p, chance = (a == b).mean(axis=1), 2.0**-BITS
    j = np.clip((p - chance) / (1 - chance), 0.0, 1.0)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), j)


def in_order(docs: DataFrame, rows_each: int = 2000) -> DataFrame:
    """(bucket, extra, key, doc_id, text) dealt so that each bucket, sorted, is a run of the table by descending doc_id.

    extra 1 marks a copy of the row that follows the bucket's last one, which is the first row of the next lower bucket
    that has rows, for the lowest bucket of the highest. So the texts are shuffled once. Null doc_id comes last.
    """
    d = with_columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    n = d.agg(F.count("*")).first()[0]
    buckets = min(20_000, parts_for(d, rows_each, n))
    cuts = d.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 20_000)).first()[0] if buckets > 1 else []
    splits = [-float("inf"), *sorted({float(x) for x in cuts or []}), float("inf")]
    d = d.withColumn("key_double", F.col("key").cast("double"))
    d = Bucketizer(splits=splits, inputCol="key_double", outputCol="b", handleInvalid="error").transform(d) if len(splits) > 2 else d.withColumn("b", F.lit(0.0))
    d = d.withColumn("bucket", F.col("b").cast("int")).drop("b", "key_double")
    tops = sorted(tuple(r) for r in d.groupBy("bucket").agg(F.max("key")).collect())  # a row a bucket, 20,000 at most
    after = [(key, tops[(i + 1) % len(tops)][0]) for i, (_, key) in enumerate(tops)]
    edges = d.sparkSession.createDataFrame(after, "edge_key long, edge_bucket int")
    rows = d.join(F.broadcast(edges), d.key == edges.edge_key, "left")
    own = F.struct(F.col("bucket"), F.lit(0).alias("extra"))
    both = F.array(own, F.struct(F.col("edge_bucket").alias("bucket"), F.lit(1).alias("extra")))
    rows = rows.select(F.explode(F.when(F.col("edge_key").isNull(), F.array(own)).otherwise(both)).alias("to"), "key", "doc_id", "text")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("to.bucket", "to.extra", "key", "doc_id", "text").repartition(max(parts, 1), "bucket")
    return rows.sortWithinPartitions("bucket", "extra", F.col("key").desc(), "text")


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def fingerprint_rows(docs: DataFrame, k: int = SHINGLE, rows_each: int = 2000) -> DataFrame:
    """A row for each document with its fingerprint, that of its edited text, and the likenesses.

    Words are what white space parts; a text of fewer than k words is one shingle. Null text counts as empty. Texts
    without words have the empty fingerprint: likeness 1 to each other and 0 to all others. Rows of equal doc_id follow
    each other by text. With one row, the next document is itself. An empty table gives no rows.
    """

    def score(rows):
        """rows: (doc_id, text, next text)."""
        if not rows:
            return pa.RecordBatch.from_pylist([], schema=RESULT)
        hashes = _HASHES
        edited = []
        for _, t, nxt in rows:
            m = len(t) // 3
            edited.append(t[: len(t) - m] + nxt[:m])
        texts = [r[1] for r in rows] + edited + [r[2] for r in rows]
        split = [t.split() for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        h = np.fromiter((x for w in split for x in map(hashes.__getitem__, w)), np.uint64, int(lengths.sum()))
        low = signatures(h, lengths, k)
        n = len(rows)
        own, new, nxt = low[:n], low[n : 2 * n], low[2 * n :]
        columns = [[r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(t.encode()).hexdigest() for t in edited], packed(own), packed(new)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, likeness(own, new), likeness(own, nxt)], RESULT.types)], schema=RESULT)

    def run(batches):
        last = None  # bucket, doc_id, text of the row that waits for the next one
        for b in in_blocks(batches, 400):
            todo = []
            for bucket, extra, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text"))):
                if last is not None and last[0] == bucket:
                    todo.append((last[1], last[2], text))
                last = None if extra else (bucket, doc_id, text)
            yield score(todo)

    return in_order(docs, rows_each).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_HASHES = WordHashes()


def op3_fingerprints(spark, sf_dir) -> DataFrame:
    """Every document of the table."""
    return fingerprint_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
