import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeledger.llm import collocations as C
from plumeledger.llm import conversation_repair as R
from plumeledger.llm import oracles, registry, sharding
from plumeledger.llm.shared import shared_dir, written

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op11_stratified_shards", "op12_collocations", "op13_conversation_repair"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    r = con.execute(oracles.SQL[name])
    at = [[c[0] for c in r.description].index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(row[i] for i in at)) for row in r.fetchall())


# --- shards


def shards_of(spark, df, n):
    folder = shared_dir(spark, "t")
    sharding.write_shards(df, folder, n)
    return sharding.read_shards(spark, folder, df)


def test_shards_follow_the_mixture(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.expr("case when id % 3 = 0 then 'hot' when id % 100 = 1 then null else concat('s', id % 7) end").alias("source"))
    rows = shards_of(spark, df, 16).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    counts, of = Counter(r.shard for r in rows), Counter(r.source for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for (s, src), n in Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - of[src] / 16) <= 2
    by_slot = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(by_slot, range(3000))[0, 1]) < 0.1


def test_shards_of_many_sources_of_one_row(spark):
    df = spark.range(1600).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.col("id").cast("string").alias("source"))
    own = {r.doc_id: r.shard for r in shards_of(spark, df, 16).collect()}
    assert set(Counter(own.values()).values()) == {100}


def test_shards_of_odd_rows(spark, odd_docs):
    df = odd_docs.unionAll(odd_docs).withColumn("slot", F.lit("own"))
    rows = shards_of(spark, df, 4).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(4)) and max(counts.values()) - min(counts.values()) <= 1
    again = shards_of(spark, df.repartition(7), 4)
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in again.collect()) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows)
    assert shards_of(spark, df.limit(0), 4).count() == 0


# --- collocations


def test_mixing_is_invertible():
    rng = np.random.default_rng(1)
    for width in (1, 2, 7, 31, 33, 63, 64):
        x = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & C._mask(width)
        y = C.mixed(x, width)
        assert (y <= C._mask(width)).all() and (C.unmixed(y, width) == x).all()
    small = np.arange(1 << 9, dtype=np.uint64)
    assert len(np.unique(C.mixed(small, 9))) == 1 << 9


@pytest.mark.parametrize("width", [1, 8, 13, 40, 64])
def test_filters_are_lossless(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 50, 3000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) & C._mask(width))
        counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], len(keys)).astype(np.int64)
        k, c, w = C.from_filter(C.to_filter(keys, counts, width))
        assert w == width and (k == keys).all() and (c == counts).all()


def test_merged_filters_add_up():
    rng = np.random.default_rng(5)
    want, filters = Counter(), []
    for _ in range(7):
        keys, counts = np.unique(rng.integers(0, 300, 200, dtype=np.uint64), return_counts=True)
        want.update(dict(zip(keys.tolist(), (counts * 90).tolist())))
        filters.append(C.to_filter(keys, counts * 90, 20))
    keys, counts, _ = C.merged(filters)
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys.astype(np.int64)) > 0).all()


def brute(rows, least, top, longest=5):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]], n[lang], score, a))
        out += [(lang, i, r[2].decode(), r[7], r[3], r[4], r[5], r[6]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations_against_brute_force(spark):
    rng = random.Random(3)
    words = ["New", "york", "of", "the", "é", "ab\x0bc", "x.y", "a\tb", "z z"]
    rows = [(rng.choice(["en", "fr", None, ""]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) + rng.choice([".", "\n", "  "])) for _ in range(60)]
    rows += [("en", None), (None, None), ("en", ""), ("de", " \t "), *[("en", "in new york city hall today")] * 9]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    for least, top in ((3, 1000), (8, 5)):
        got = C.top_collocations(df, top=top, min_count=least)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_collocations_in_small_steps(spark, monkeypatch):
    """Flushing often and cutting filters finely changes nothing; the count is exact beyond 64 bits of product."""
    rows = [("en", "a b c d e f " * 40)] * 4
    monkeypatch.setattr(C, "CUT_WORDS", 10)
    got = sorted(map(tuple, C.top_collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=100).collect()))
    assert got == brute(rows, 100, 2000) and got
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.top_collocations(empty).count() == 0
    assert C.top_collocations(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string")).count() == 0


def test_counting_in_parts():
    import pyarrow as pa

    a = np.array([1, 2, 3, 0, 1, 2, 3, 1, 2] * 50, np.uint32)
    batch = [pa.RecordBatch.from_arrays([pa.array([a.tobytes(), b""], pa.binary())], names=["ids"])]
    out = [b for b in C._count_phrases(batch, [], 2, 4, 2)]
    got = {}
    for b in out:
        for cut, data in zip(b.column("cut").to_pylist(), b.column("filter").to_pylist()):
            k, c, w = C.from_filter(data)
            x = C.unmixed(k | np.uint64(cut << w), 4)
            got |= dict(zip(((int(v) >> 2, int(v) & 3) for v in x), c.tolist()))
    assert got == Counter((int(x), int(y)) for x, y in zip(a, a[1:]) if x and y)


# --- conversations


def cheapest(turns):
    """(cost, audit, states) by trying all edits, three inserts in a row at most."""
    best = None
    stack = [(0, 0, "", 0, 0)]
    while stack:
        i, s, audit, cost, inserts = stack.pop()
        if best is not None and cost > best[0]:
            continue
        if i == len(turns) and s in R.ENDS:
            best = min(best or (cost, audit), (cost, audit))
        if inserts < 3:
            stack.append((i, R.WRITTEN[s][1], audit + "I", cost + 3, inserts + 1))
        if i < len(turns):
            initial, go, cut = turns[i]
            stack.append((i + 1, s, audit + "D", cost + 4, 0))
            if not go:
                if (s, initial) in R.NEXT:
                    stack.append((i + 1, R.NEXT[s, initial], audit + "K", cost + 3 * cut, 0))
                stack.append((i + 1, R.WRITTEN[s][1], audit + "R", cost + 3 + 3 * cut, 0))
    return best


def test_repair_against_all_edits():
    kinds = [(i, g, c) for i in "sua " for g, c in ((False, False), (True, False), (False, True))]
    rng = random.Random(11)
    cases = [list(t) for n in range(3) for t in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds) for _ in range(rng.randrange(3, 7))] for _ in range(150)]
    for turns in cases:
        for cut in {len(turns), 1, 2} - {0}:
            tables = [R.block_table(turns[i : i + cut]) for i in range(0, len(turns), cut)]
            cost, parts = R.chain(tables)
            assert (cost, "".join(p[1] for p in parts)) == cheapest(turns), (turns, cut)


def test_paths_compare_like_strings():
    rng = random.Random(2)
    for base, mask in ((R._BASE, R._MASK), (1, 3)):  # the second hash collides all the time
        paths, spelled = R.Paths(base, mask), {0: ""}
        for _ in range(300):
            node = rng.choice(list(spelled))
            x = rng.choice("DIKR")
            spelled[paths.push(node, x)] = spelled[node] + x
        for _ in range(4000):
            a, b = rng.choice(list(spelled)), rng.choice(list(spelled))
            assert paths.spell(a) == spelled[a] and paths.less(a, b) == (spelled[a] < spelled[b])


def test_repaired_turns_alternate(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "", None, "tool"]), rng.choice(["Yes.", "no", "", None, " \n", "Why?"])) for c in (1, 2, 3, None) for _ in range(rng.randrange(1, 14))]
    rows += [(5, t, "user", "Same words.") for t in range(0, 40)] + [(6, None, None, None)] * 3
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string").repartition(3)
    damaged = R.damage(df)
    plans, fixed = R.repair(damaged, block=4)
    plans1, fixed1 = R.repair(damaged, block=1000)
    narrow = lambda p: sorted(map(str, p.drop("parts").collect()))
    assert narrow(plans) == narrow(plans1)
    assert sorted(map(tuple, R.digests(fixed).collect()), key=str) == sorted(map(tuple, R.digests(fixed1).collect()), key=str)
    for conv in {r.conv_id for r in plans.collect()}:
        turns = [t for r in sorted(fixed.where(F.col("conv_id").eqNullSafe(conv)).collect(), key=lambda r: (r.block is not None, r.block)) for t in r.turns]
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))
    by = {r.conv_id: r for r in plans.collect()}
    kept = sum(zlib.crc32(f"5:{t}".encode()) % 20 not in (0,) for t in range(40))
    assert by[5].duplicate > 0 and len(by[5].audit) >= kept
    assert R.repair(damaged.limit(0))[0].count() == 0


def test_damage_follows_the_rule(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    got = written(R.damage(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")), "t").collect()
    want = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            want[row] += 2 if k == 3 else 1
    assert Counter(map(tuple, got)) == want
