import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeledger.llm import components, decontaminate, fingerprints, html_extract, jaccard_join, line_dedup, ngram_trie, packing, toxicity, warc_records
from plumeledger.llm import token_records as tr
from plumeledger.llm.shared import shared_dir, written


def test_checksums():
    import random

    assert tr.crc32c(b"123456789") == 0xE3069283
    items = [random.Random(n).randbytes(n) for n in (4, 63, 64, 65, 1000, 4097)]
    assert tr.crc32c_each(items).tolist() == [tr.crc32c(x) for x in items]
    whole = b"".join(tr.frames(items))
    at, places = 0, []
    for x in items:
        places.append((at, len(x) + 16))
        at += len(x) + 16
    assert tr.unframed(whole, places) == items
    with pytest.raises(ValueError):
        tr.unframed(whole[:20] + b"!" + whole[21:], places)


def test_token_records_round_trip(spark, odd_docs):
    P = pytest.importorskip("public_tokenizers")
    path, folder = P.path("byte_bpe_50k.json"), shared_dir(spark, "t")
    got = tr.read_token_records(written(tr.write_token_records(odd_docs, path, folder, shards=3), "m"), folder).collect()
    tok = tr.encoder(path).tok
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()))
    start = 0
    for r, (known, doc_id, text) in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id if known else None, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_fingerprints(spark, odd_docs):
    got = fingerprints.fingerprint_rows(odd_docs, rows_each=3).collect()
    order = sorted(odd_docs.collect(), key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), r.text or ""))
    texts = [r.text or "" for r in order]
    want = Counter()
    for i, t in enumerate(texts):
        nxt, m = texts[(i + 1) % len(texts)], len(t) // 3
        want[order[i].doc_id, len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    same = {r.fingerprint for r in got if r.doc_id in (1, 6)}
    assert len(same) == 1
    h = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = h[:2000], h[500:2500]
    low = fingerprints.signatures(np.concatenate([a, b]), np.array([2000, 2000]), 1)
    assert abs(fingerprints.likeness(low[:1], low[1:])[0] - 1500 / 2500) < 0.12


def test_toxicity_held_out():
    rng = np.random.default_rng(1)
    def doc(bad):
        s = [" ".join(f"w{rng.integers(400)}" for _ in range(8)) for _ in range(rng.integers(1, 40))]
        if bad:
            s[rng.integers(len(s))] += " vile" + "abcdef"[rng.integers(6)]
        return ". ".join(s)
    rows = [(doc(i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    score = toxicity.Scorer(*toxicity.fit(rows[:600]))
    right = [(score(t)[0] >= 0.3) == bool(y) for t, y in rows[600:]]
    assert np.mean(right) > 0.97
    p, n, where = score("w1 w2. w3 vilea w4. w5")
    assert p >= 0.3 and n == 3 and where == [1]


def test_toxicity_odd_rows(spark, odd_docs):
    model = toxicity.train(odd_docs, spark.createDataFrame([(1, 1), (6, 0), (None, 1), (3, None)], "doc_id long, toxic int"))
    got = toxicity.score(odd_docs, model)
    assert got.count() == odd_docs.count() and [r.score for r in got.where("text is null").collect()] == [0.0, 0.0]
    assert toxicity.fit([])[1] == {}


def test_html_blocks_and_model():
    blocks = html_extract.leaf_blocks("<p>a &amp; b<p>c <b>d</b>\n e<script>x</p></script><ul><li>1<li>2</ul>tail<div class='ad'>z</div><a href=")
    assert [b[0] for b in blocks] == ["a & b", "c d e", "1", "2", "tail", "z"]
    assert ".ad" in blocks[-1][1] and html_extract.leaf_blocks(None) == []
    best = max(((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)), key=lambda y: sum(e * v for e, v in zip((1.0, -2.0, 1.5), y)) + sum(((0.5, -1.0), (-0.7, 0.9))[i][j] for i, j in zip(y, y[1:])))
    assert html_extract.viterbi([1.0, -2.0, 1.5], [[0.5, -1.0], [-0.7, 0.9]]) == list(best)


def test_line_dedup(spark, odd_docs):
    line = "the quick brown fox jumps over the lazy dog near the old river bank on a cold morning in late autumn while we watch"
    rows = [(1, f"{line}\nshort one\nunique words here are only in the first text"), (2, f"other things\n{line.upper()}!"), (3, "short one\n" + line)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(d).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "other things" and got[3].text == "short one"
    odd = line_dedup.line_dedup(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("doc_id = 6").first().text == "" and odd.where("doc_id = 2").first().text is None
    assert line_dedup.line_dedup(d.limit(0)).count() == 0


def test_packing(spark, odd_docs):
    got = packing.best_fit(odd_docs, sizes=(16, 64, 256)).collect()
    by_bin = defaultdict(list)
    for r in got:
        by_bin[r.bin_id, r.bin_size].append((r.bin_offset, r.n_tokens))
    for (_, size), rows in by_bin.items():
        end = 0
        for at, n in sorted(rows):
            assert at == end
            end += n
        assert end <= size and size == min(c for c in (16, 64, 256) if c >= end)
    assert sum(r.n_tokens for r in got) == sum(len((r.text or "").split()) + 1 for r in odd_docs.collect())


def test_lm_against_brute_force(spark, odd_docs):
    got = ngram_trie.lm_scores(odd_docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    tok = lambda t: [*(t or "").encode().lower().split(), b" "]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c, bi, n = Counter(), Counter(), 0
    for d, t in rows:
        if not held(d):
            w = tok(t)
            c.update(w)
            bi.update(zip([b" ", *w], w))
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    disc = once / (once + 2 * twice)
    puni = lambda w: (c[w] - disc) / n if w in c else disc * v / n
    want = Counter()
    for d, t in rows:
        w = tok(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((bi[a, b] + ngram_trie.MU * puni(b)) / (c[a] + ngram_trie.MU)) if a in c else math.log10(puni(b)) for a, b in zip([b" ", *w], w))
        want[d, held(d), len(w), sum(x in c for x in w), n, round(base, 6), round(score / len(w), 1)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score / r.n_tokens, 1)) for r in got) == want


def test_elias_fano():
    rng = np.random.default_rng(3)
    for universe in (10, 1000, 1 << 40):
        x = np.sort(rng.integers(0, universe, 500)).astype(np.uint64)
        ef = ngram_trie.EliasFano.build(x, universe)
        assert (ngram_trie._access(ef, np.arange(500)) == x.astype(np.int64)).all()
        q = rng.integers(0, universe, 300).astype(np.uint64)
        found = ef.find(q)
        assert ((found >= 0) == np.isin(q, x)).all() and (x[found[found >= 0]] == q[found >= 0]).all()


def test_decontamination_odd_rows(spark, odd_docs):
    span = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([("i1", span), ("i2", "Short item"), ("i3", None), (None, "")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(span.split()[3:17]) + " z"), (2, "x " + " ".join(span.split()[:12])), (3, "a SHORT, item b")], "doc_id long, text string")
    for size in (1 << 20, 60):
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, broadcast_bytes=size).collect()}
        assert (got[1].n_hit, got[1].item_ids, got[2].n_hit, got[3].n_hit, got[3].item_ids) == (14, ["i1"], 0, 2, ["i2"])
    assert decontaminate.contamination(odd_docs, bench).where("contaminated").count() == 0
    assert decontaminate.contamination(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (9, 12), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 9, 11: 9, 12: 9} | {100 + i: 100 for i in range(41)}


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        words = [f"v{rng.integers(5000)}" for _ in range(int(rng.integers(30, 400)))]
        for _ in range(12):
            w = list(words)
            for _ in range(int(rng.integers(0, max(2, len(w) // 40)))):
                w[rng.integers(len(w))] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(w))
    texts += ["a b", "a b", "", None, "c"]
    sets = [frozenset(zip(w, w[1:], w[2:])) if len(w := (t or "").split()) >= 3 else frozenset([tuple(w)] if w else []) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, root))}


def test_jaccard_odd_rows(spark, odd_docs):
    got = jaccard_join.linked_components(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.component_id for r in got if r.doc_id in (1, 6)} == {1}


def test_count_tree():
    rng = np.random.default_rng(2)
    p = rng.poisson(5, (300, jaccard_join.COORDINATES)).astype(np.int32)
    n = p.sum(axis=1)
    tree = jaccard_join.CountTree(p, n)
    for i in range(0, 300, 37):
        want = np.flatnonzero(190 * np.minimum(p, p[i]).sum(axis=1) >= 90 * (n + n[i]))
        assert sorted(tree.search(p[i], n[i], 90, 100)) == want.tolist()


def test_warc(spark):
    big = "<p>é" * 60_000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c%\n", "x" * 999), (4, "http://d", "x" * 999), (5, "u", None), (None, "v", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = shared_dir(spark, "w")
    table = warc_records.read_warc(written(warc_records.write_warc(warc_records.revisits(pages), folder), "a"), folder).collect()
    last = {r.page_id: r for r in table if r.last}
    assert [(i, last[i].record_type, last[i].refers_to) for i in (1, 2, 3, 4, 5, None)] == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (None, "revisit", 2)]
    assert last[2].payload_digest == hashlib.sha1(big.encode()).hexdigest() == last[1].payload_digest and last[1].payload_bytes == len(big.encode())
    assert b"".join(r.chunk for r in sorted((r for r in table if r.page_id == 2), key=lambda r: r.chunk_no)) == big.encode()
    assert max(len(r.chunk) for r in table) <= warc_records.CHUNK and last[3].url == "http://c%\n" and last[5].payload_bytes == 0


def _distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_simhash_and_edit_similarity(spark):
    lists = [[], ["a"], ["a", "b"], list("abcde") * 3, [str(i * i) for i in range(63)], [str(i) for i in range(64)], [f"w{i % 400}" for i in range(17_000)]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    got = {r.i: r for r in df.select("i", line_dedup.simhash(F.col("w")).alias("s"), F.transform("w", lambda x: F.xxhash64(x)).alias("h")).collect()}
    for i, w in enumerate(lists):
        bits = [2 * sum(h >> j & 1 for h in got[i].h) > len(w) for j in range(64)]
        assert got[i].s == sum(b << j for j, b in enumerate(bits[:63])) - (bits[63] << 63)

    pool = ["", "abc", "kitten sitting", "sitting kitten", "a b c d e f g h", "x b c d e f g h", "a b c d e f g x", "b c d e f g h", "a b c d d e f g h", "é𝄞 x", "é𝄞x y", "one two three four five", "one two thre four five", "one two four five"]
    pairs = spark.createDataFrame([(i, j, x.split(), y.split()) for i, x in enumerate(pool) for j, y in enumerate(pool)], "a long, b long, x array<string>, y array<string>")
    got = {(r.a, r.b) for r in line_dedup._edit_similar(pairs, 0.8).collect()}
    assert got == {(i, j) for i, x in enumerate(pool) for j, y in enumerate(pool) if _distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)}


def test_line_dedup_recall_by_length(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(3, 10)))
    rows, of = [], {}
    for n in (5, 8, 10, 15, 20, 40, 100):
        for _ in range(40):
            a = [word() for _ in range(n)]
            b = list(a)
            b[rng.integers(n)] = word()
            x, y = " ".join(a), " ".join(b)
            if _distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                of[len(rows) + 1] = n
                rows += [(len(rows), x), (len(rows) + 1, y)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(v == 0 for k, v in got.items() if k not in of)
    found, sought = Counter(), Counter()
    for k, n in of.items():
        sought[n] += 1
        found[n] += got[k]
    assert all(found[n] >= 0.95 * sought[n] for n in sought), (found, sought)


def test_line_dedup_of_a_bucket_of_unlike_lines(spark, monkeypatch):
    """Copies that share one key alone, with unlike lines between them and another line first in their bucket, are found, whatever the cells' size."""
    monkeypatch.setattr(line_dedup, "CELL", 7)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + i) for i in rng.integers(0, 26, n))
    shared = [word(20) for _ in range(4)]  # the longest pairs of every line
    rows = []
    for _ in range(40):
        a = [word(rng.integers(4, 11)) for _ in range(40)]
        b = [w[:-1] + ("a" if w[-1] != "a" else "b") if i % 6 == 0 else w for i, w in enumerate(a)]
        rows += [(len(rows), " ".join(shared + a)), (len(rows) + 1, " ".join(shared + b))]
    monkeypatch.setattr(line_dedup, "BLOCKS", 1)  # no key but that of the shared words
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(0, 80, 2))
    assert sum(got[k] for k in range(1, 80, 2)) >= 38, got  # SimHashes of a few may lie too far apart


def test_line_dedup_of_a_passage_in_many_lines(spark, monkeypatch):
    """Lines that are alike by a passage they all quote, and by the shortest of them, are not all compared with each other."""
    rng = np.random.default_rng(4)
    word = lambda low, high: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(low, high)))
    passage = " ".join(word(8, 11) for _ in range(45))
    some = lambda: " ".join(word(3, 6) for _ in range(17))
    rows = [(0, passage)] + [(i, f"{some()} {passage}" if i % 2 else f"{passage} {some()}") for i in range(1, 61)]
    compared, similar = [], line_dedup._edit_similar
    monkeypatch.setattr(line_dedup, "_edit_similar", lambda pairs, *a: compared.append(pairs.count()) or similar(pairs, *a))
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i > 0) for i, _ in rows}
    assert sum(compared) <= 6 * len(rows), compared


def test_letters_reject_no_similar_pair(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for i in range(200):
        x = y = "".join(rng.choice(list("abcdeéñ жш漢9 "), rng.integers(1, 60)))
        for _ in range(rng.integers(0, 16)):
            k = rng.integers(len(y) + 1)
            y = y[:k] + str(rng.choice(["", "a", "z", "é", " "])) + y[k + rng.integers(2) :]
        pairs.append((i, x, y))
    pairs += [(200, "a" * 30, "b" * 30), (201, "", "")]
    t = spark.createDataFrame(pairs, "i int, x string, y string")
    t = t.withColumns({"lx": line_dedup._letters(F.col("x")), "ly": line_dedup._letters(F.col("y"))})
    kept = {r.i for r in t.where(line_dedup._within(F.length("x"), F.col("lx"), F.length("y"), F.col("ly"), 0.8)).collect()}
    assert kept >= {i for i, x, y in pairs if _distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)} and 200 not in kept


def test_line_dedup_of_every_line(spark, tmp_path):
    rows = [(1, "Share this\n今日は天気がいいですね\n---\n\nonly here"), (2, "share this\n今日は天気がいいですね\n***"), (3, "\nshare this!\n---\nonly there")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    # "only there" is "only here" but for one of ten characters: a duplicate at similarity 0.8.
    assert got == {1: (0, rows[0][1]), 2: (2, "***"), 3: (3, "")}


def test_token_ids_of_other_white_space():
    P = pytest.importorskip("public_tokenizers")
    enc = tr.encoder(P.path("byte_bpe_50k.json"))
    texts = ["a\tb\tc\n\n", "un\u00a0mot\u00a0: oui  non ", "a b\nc d", "a\n\nb\rc", " a", "a \nb\tc", "\n", " ", "a\u2028b\n"]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, f"<{enc.code}").tolist() for x in enc(texts)] == want


def test_token_pieces_are_learned_in_few_calls():
    """New words, at the start of lines too, go to the tokenizer many at a time, and all ids are those of whole texts, whether the cache is new, full or emptied."""
    P = pytest.importorskip("public_tokenizers")
    enc = tr.Encoder(P.path("byte_bpe_50k.json"))
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i * 7919)) + ["", ".", ",", "é", "'s", "9", "-x!", "?!"][i % 8]
    texts = ["\n".join(f"{word(9 * i + j)} {word(9 * i + j + 4)}" for j in range(9)) for i in range(90)]
    texts += ["", "a  b", "x <|endoftext|> y", " a", "b\n", "Don't.\nDon't", "\u00a0"]
    want = [np.array(enc.tok.encode(t, add_special_tokens=False).ids, f"<{enc.code}").tobytes() for t in texts]

    class Counted:
        def __init__(self, tok):
            self.tok, self.calls = tok, 0

        def encode_batch_fast(self, *args, **kwargs):
            self.calls += 1
            return self.tok.encode_batch_fast(*args, **kwargs)

    enc.tok = Counted(enc.tok)
    assert enc(texts) == want and enc.tok.calls < 80
    assert [enc([t])[0] for t in texts] == want
    enc._forget()
    assert enc(texts[50:]) == want[50:] and enc(texts) == want


def test_packing_opens_by_cost_and_matches_brute_force():
    import itertools
    import random

    def least(lengths, sizes, overhead):
        """The cheapest packing of a few lengths, over all ways to part them into bins."""
        best = None
        for bins in itertools.product(range(len(lengths)), repeat=len(lengths)):
            fill = {}
            for n, b in zip(lengths, bins):
                fill[b] = fill.get(b, 0) + n
            if max(fill.values()) <= max(sizes):
                cost = sum(min(c for c in sizes if c >= f) + overhead for f in fill.values())
                best = cost if best is None else min(best, cost)
        return best

    rnd = random.Random(5)
    for _ in range(30):
        lengths = sorted((rnd.randint(1, 16) for _ in range(5)), reverse=True)
        bins, size, cost = packing.pack(lengths, (4, 8, 16), 1)
        fill = [sum(n for n, b in zip(lengths, bins) if b == i) for i in range(len(size))]
        assert all(f <= s and s == min(c for c in (4, 8, 16) if c >= f) for f, s in zip(fill, size))
        best = least(lengths, (4, 8, 16), 1)
        assert best <= cost <= 1.5 * best
    joint = packing._pack([9, 9, 3, 3, 1], None, (4, 12), 1)
    assert joint[1] == [12, 12, 1]  # a bin that can be filled whole is opened large, the last one small




def test_points_bound_the_overlap_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 5, 300, 9000, 40_000)]
    left = [a for a in sets for _ in sets]
    right = [np.unique(np.concatenate([b, a[::2]])) for a in sets for b in sets]
    bounds = jaccard_join.overlap_bounds([jaccard_join.point(x) for x in left], [jaccard_join.point(x) for x in right])
    assert all(bound >= len(np.intersect1d(x, y)) for bound, x, y in zip(bounds, left, right))
    assert jaccard_join.overlap_bounds([jaccard_join.point(x) for x in sets], [jaccard_join.point(x) for x in sets]).tolist() == [len(x) for x in sets]
    assert jaccard_join.overlap_bounds([], []).tolist() == []
