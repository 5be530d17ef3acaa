"""Documents linked by the Jaccard similarity of their word n-gram sets, exactly, with a count-vector R-tree.

A set's shingle hashes fall into groups; the groups' counts are a point. Two sets share at most the sum of the coordinate
minima of their points, and so do all sets under an R-tree node with the node's coordinate maxima, which prunes the
search; what survives is verified on the sets themselves.

One tree over all points would not prune: the boxes of unlike documents overlap in nearly every coordinate, and the
search would hold each document against all of similar size. So points are first dealt out by the contents of
their groups. (A node of the tree has 64 coordinates; what it lets through is bounded once more by the minima over 256
coordinates or more, so little but links is left to verify.) Sets of a and b shingles that are similar enough differ in at most r = (a + b) * (1 - t) / (1 + t) shingles;
cut into r + 1 groups by hash they agree in one group at least. Documents that agree in a group of their size band meet
in a bucket. Of a bucket, every set is held against the least one first, by their points and then by themselves; only sets that this leaves in
different components are searched against each other, in a tree over the bucket, large buckets in pairs of blocks: first for as few pairs as join them, then for all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumeledger.llm.components import components, join_counted
from plumeledger.llm.shared import WordHashes, importable, in_blocks, mix, shingles, with_columns_of, written

SHINGLE = 3
SIMILARITY = (90, 100)
COORDINATES = 64
#: Coordinates of the last bound, at least.
FINE = 256
BLOCK = 1024
NODE = 16
_RATIO = math.log(1.25)


def band(n: int) -> int:
    return int(math.log(n) / _RATIO + 1e-9)


def _largest(j: int) -> int:
    n = int(math.exp(j * _RATIO))
    while band(n + 1) <= j:
        n += 1
    return n


def differing(j: int, num: int, den: int) -> int:
    """The most shingles in which two similar sets, the larger of size band j, can differ."""
    return 2 * _largest(j) * (den - num) // (den + num)


def groups_of(j: int, num: int, den: int) -> tuple[int, int]:
    """(groups, few) of size band j: so many groups that more than `few` shingles fall into one more of them than shingles can differ.

    Small groups agree between unlike sets that share a common passage, so `few` is the greatest of 2, 1 and 0 that costs a fifth more groups at most.
    """
    least, n = differing(j, num, den) + 1, _largest(j) / 1.25
    for few in (2, 1, 0):
        m = least
        for _ in range(8):
            rate = n / m
            small = sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(few + 1))
            m = min(10 * least, int(1.03 * least / max(1 - small, 0.1)) + 1)
        if m <= 1.2 * least + 1:
            return m, few
    return m, 0


def words(text: str | None) -> list[bytes]:
    """A-Z lowered; words are what ASCII white space parts."""
    return (text or "").encode().lower().split()


_HASHES = WordHashes()


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [words(t) for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    h = np.fromiter((x for w in split for x in map(_HASHES.__getitem__, w)), np.uint64, int(lengths.sum()))
    x, rows = shingles(h, lengths, k)
    if (lengths < k).any():
        order = np.argsort(rows, kind="stable")
        x, rows = x[order], rows[order]
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [np.unique(x[a:b]) for a, b in zip(ends, ends[1:])]


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def point(s: np.ndarray) -> bytes:
    """Counts of the set's shingles by the top bits of their hashes: FINE numbers, or as many more as leave some 16 shingles for each."""
    bits = max(FINE.bit_length() - 1, min(16, (len(s) // 16).bit_length()))
    return np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u4").tobytes()


def folded(raw: list[bytes]) -> np.ndarray:
    """Points as rows of the least size among them: neighbouring counts are added up."""
    each = [np.frombuffer(x, "<u4") for x in raw]
    least = min(map(len, each))
    return np.stack([x.reshape(least, -1).sum(axis=1) for x in each]).astype(np.int32)


def group_keys(s: np.ndarray, num: int, den: int, plan: dict) -> np.ndarray:
    """A key for the contents of each group, for each band in which a partner of the set can be the larger one.

    Groups of few shingles, and empty ones, agree between many unlike sets. They have no key, unless the set has too few
    others: similar sets differ in r shingles at most, so if one of them has more than r larger groups, both have one of these in common.
    """
    n, out = len(s), []
    y = mix(s)
    for j in range(band(n), band(n * den // num) + 1):
        if j not in plan:
            plan[j] = *groups_of(j, num, den), differing(j, num, den)
        m, few, r = plan[j]
        group = ((y >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        contents = np.zeros(m, np.uint64)
        np.add.at(contents, group, y)
        keys = mix(contents + mix(np.arange(m, dtype=np.uint64) + np.uint64(j << 32)))
        size = np.bincount(group, minlength=m)
        for least in range(few, -1, -1):
            some = size > least
            if some.sum() > r:
                keys = keys[some]
                break
        out.append(keys)
    return np.concatenate(out).view(np.int64)


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(row, doc_id, n, set_id, keys), a row a document; no keys and a null set_id for those without words. row tells rows apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        plan: dict[int, tuple[int, int]] = {}
        first = TaskContext.get().partitionId() << 40
        for b in in_blocks(batches, 400):
            sets = shingle_sets(b.column("text").to_pylist(), k)
            ids = [set_id(s) if len(s) else None for s in sets]
            keys = [group_keys(s, num, den, plan) if len(s) else None for s in sets]
            sizes = np.cumsum([0] + [0 if x is None else len(x) for x in keys])
            flat = np.concatenate([x for x in keys if x is not None]) if sizes[-1] else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
            rows = pa.array(np.arange(first, first + b.num_rows))
            first += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), lists], names=["row", "doc_id", "n", "set_id", "keys"])

    return docs.mapInArrow(run, f"row long, doc_id {kind}, n long, set_id long, keys array<long>")


def _contents(docs: DataFrame, k: int) -> DataFrame:
    """(set_id, n, shingles, point) of each row that has words; point has its counts."""

    def run(batches):
        for b in in_blocks(batches, 400):
            sets = [s for s in shingle_sets(b.column("text").to_pylist(), k) if len(s)]
            rows = [set_id(s) for s in sets], [len(s) for s in sets], [s.view(np.int64) for s in sets], [point(s) for s in sets]
            types = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["set_id", "n", "shingles", "point"])

    return docs.mapInArrow(run, "set_id long, n long, shingles array<long>, point binary")


class CountTree:
    """An R-tree over count points: nodes of NODE entries with coordinate maxima and the least set size below them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points[:, 0], sizes))
        self.order, self.levels = order, [(points[order], sizes[order])]
        while len(self.levels[-1][0]) > NODE:
            p, n = self.levels[-1]
            starts = np.arange(0, len(p), NODE)
            self.levels.append((np.maximum.reduceat(p, starts), np.minimum.reduceat(n, starts)))

    def search(self, q: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Entries whose bound on the overlap with (q, n) reaches what the similarity needs."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            p, sizes = self.levels[level]
            bound = np.minimum(p[at], q).sum(axis=1)
            at = at[(den + num) * bound >= num * (sizes[at] + n)]
            if level:
                at = (at[:, None] * NODE + np.arange(NODE)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]


def expected(bound: np.ndarray, n: int, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """The overlap to expect where points bound it: less what shingles that differ share of the coordinates by chance."""
    return bound - (n - bound) * (sizes - bound) / coordinates


def _tree_pairs(rows: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """Candidate pairs of rows (key, set_id, n, point, root) of one bucket but different roots.

    best: only what is likely to join the roots of a bucket, in place of all its pairs. Each row gives its candidate of the
    highest bound in each other group of roots; one whose expected overlap suffices makes one group of the two, and no
    further pair is sought between them. Whether they are joined indeed, the sets decide; the search after it misses nothing.
    """
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).select(F.col("key").alias("k"), "blocks")
    r = rows.join(counts.hint("merge"), rows.key == counts.k).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    r = r.select("key", "set_id", "n", "point", "root", "own", other.alias("o"))
    r = r.select("key", "set_id", "n", "point", "root", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))

    def run(key, table):
        ids, sizes, roots, own = (table.column(c).to_numpy().astype(np.int64) for c in ("set_id", "n", "root", "own"))
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        if len(left) and len(right) and len(np.unique(roots)) > 1:
            points = folded(table.column("point").to_pylist())
            coarse = points.reshape(len(points), COORDINATES, -1).sum(axis=2)
            tree = CountTree(coarse[right], sizes[right])
            group = np.unique(roots, return_inverse=True)[1]
            for x in left:
                y = right[tree.search(coarse[x], sizes[x], num, den)]
                y = y[(roots[y] != roots[x]) & (ids[y] != ids[x])]
                bound = np.minimum(points[y], points[x]).sum(axis=1)
                ok = (den + num) * bound >= num * (sizes[y] + sizes[x])
                y, bound = y[ok], bound[ok]
                if best and len(y):
                    y, bound = y[group[y] != group[x]], bound[group[y] != group[x]]
                    order = np.lexsort((-bound, group[y]))
                    y, bound = y[order], bound[order]
                    first = np.flatnonzero(np.diff(group[y], prepend=-1))
                    y, bound = y[first], bound[first]
                    sure = (den + num) * expected(bound, sizes[x], sizes[y], points.shape[1]) >= num * (sizes[y] + sizes[x])
                    if sure.any():
                        group[np.isin(group, group[y[sure]])] = group[x]
                elif i == j:
                    y = y[ids[y] > ids[x]]
                a.append(np.minimum(ids[x], ids[y]))
                b.append(np.maximum(ids[x], ids[y]))
        cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cat(a)), "b": pa.array(cat(b))})

    return r.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def overlap_bounds(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each pair of points, folded to the smaller of the two, the sum of its coordinate minima: no two such sets share more."""
    out = np.zeros(len(left), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(left, right)], np.int64).reshape(-1, 2)
    for a, b in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == a) & (sizes[:, 1] == b))
        least = min(a, b) // 4
        x, y = (np.frombuffer(b"".join(side[i] for i in at), "<u4").reshape(len(at), least, -1).sum(axis=2) for side in (left, right))
        out[at] = np.minimum(x, y).sum(axis=1)
    return out


def _sifted(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose points leave the similarity possible; points are some tenth of the bytes of shingles, which need not be shuffled for the others."""
    x = points.select(F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    y = points.select(F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)

    def run(batches):
        for b in batches:
            for c in in_blocks([b], 1000):
                bound = overlap_bounds(c.column("p_a").to_pylist(), c.column("p_b").to_pylist())
                n = c.column("n_a").to_numpy() + c.column("n_b").to_numpy()
                yield c.select(["a", "b"]).filter(pa.array((den + num) * bound >= num * n))

    return both.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs, a written table, that are links by their sets."""
    wanted = written(pairs.select(F.col("a").alias("w")).unionAll(pairs.select("b")).distinct(), "jaccard-wanted")
    sets = join_counted(sets, wanted, F.col("set_id") == F.col("w"), "left_semi")
    x = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    y = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where((den + num) * shared >= num * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()


def linked_components(docs: DataFrame, *, k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Two documents link when den * intersection >= num * union of their sets of k-word shingles; component_id is the
    least doc_id of those reachable. Texts of fewer words are one shingle; null, empty and blank texts have no set and
    stand alone. Rows of one doc_id are judged each by its own text. A row of null doc_id links like others
    but names no component; if all of a component are null its id is null. Sets are known by a 64-bit hash.
    """
    importable(docs.sparkSession)
    num, den = similarity
    d = with_columns_of(docs, "doc_id", "text")
    everything = written(_sets(d, k, num, den), "jaccard-sets")
    rows = everything.select("doc_id", "n", "set_id")
    # Of copies one set remains, and one row gives its keys: combined before the shuffle, however many copies there are.
    tops = everything.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("top"), F.min("row").alias("first"), F.count("*").alias("copies"))
    tops = written(tops, "jaccard-tops")
    copied = tops.where("copies > 1").select(F.col("set_id").alias("s"), "first")
    once = join_counted(everything.where("set_id is not null"), copied, F.col("set_id") == F.col("s"), "left")
    keys = once.where(F.coalesce(F.col("row") == F.col("first"), F.lit(True))).select("set_id", F.explode("keys").alias("key"))
    # One shuffle deals the keys out; the bucket's least set, its hub, is the first that comes.
    members = keys.withColumn("hub", F.first("set_id").over(W.partitionBy("key").orderBy("set_id"))).where("set_id <> hub")
    members = written(members, "jaccard-members")
    tried = written(members.select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct(), "jaccard-pairs")
    needed = tried.select(F.col("a").alias("set_id")).unionAll(tried.select("b")).distinct()
    reps = written(tops.join(needed.hint("merge"), "set_id", "left_semi").select(F.col("top").alias("rep")).distinct(), "jaccard-reps")
    sought = join_counted(d, reps, d.doc_id.eqNullSafe(reps.rep), "left_semi")
    sets = written(_contents(sought, k), "jaccard-contents")
    points = sets.select(F.col("set_id").alias("s"), "n", "point")
    near = written(_sifted(tried, points, num, den), "jaccard-near")
    roots = written(components(written(_verified(near, sets, num, den), "jaccard-links")), "jaccard-roots")

    # Sets of one bucket that are still in different components are searched in the bucket's tree: first for the
    # candidates that are likely to join most of what belongs together, then for all that are left.
    for best in (True, False):
        named = roots.select(F.col("node").alias("s"), "root")
        hubs = roots.select(F.col("node").alias("h"), F.col("root").alias("hub_root"))
        known = roots.count()
        m = join_counted(members, named, F.col("set_id") == F.col("s"), "left", rows=known)
        m = join_counted(m, hubs, F.col("hub") == F.col("h"), "left", rows=known)
        m = m.select("key", "set_id", F.coalesce("root", "set_id").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root"))
        split = m.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select(F.col("key").alias("k"))
        open_ = join_counted(m, written(split, "jaccard-split"), F.col("key") == F.col("k"), "left_semi")
        open_ = written(open_.join(points.hint("merge"), F.col("set_id") == F.col("s")).select("key", "set_id", "n", "point", "root"), "jaccard-open")
        rest = written(_tree_pairs(open_, num, den, best).join(tried.hint("merge"), ["a", "b"], "left_anti"), "jaccard-tree")
        if rest.isEmpty():
            break
        tried = tried.unionAll(rest)
        more = written(_verified(rest, sets, num, den), "jaccard-links")
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)), "jaccard-roots")

    named = tops.join(roots.hint("merge"), tops.set_id == roots.node, "left").select("set_id", "top", F.coalesce("root", "set_id").alias("root"))
    least = named.groupBy("root").agg(F.min("top").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    named = written(named.join(least.hint("merge"), F.col("root") == F.col("r")).select(F.col("set_id").alias("s"), "component_id"), "jaccard-named")
    got = rows.join(named.hint("merge"), rows.set_id == named.s, "left")
    alone = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def op9_jaccard_join(spark, sf_dir) -> DataFrame:
    """Every document of the table."""
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
