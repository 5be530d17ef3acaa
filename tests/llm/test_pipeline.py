import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

T = " ".join(f"alpha{i}" for i in range(60))
U = " ".join(f"beta{i}" for i in range(60))
TOXIC = "you stupid worthless idiot i hate you and hope you suffer"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    passage = " ".join(f"exam{i}" for i in range(30))
    spark.createDataFrame([("b1", passage), (None, None), ("b2", "")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_near_duplicates_decide_by_row(spark, folder):
    rows = [(1, T), (2, T), (2, U), (3, U + " x"), (7, "own words of seven that nobody shares at all"), (7, "own words of seven that nobody shares at all"), (None, "a null row of words repeated here"), (None, "a null row of words repeated here")]
    rows += [(8, None), (8, None), (9, ""), (None, U + " x y")]
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), folder).collect())
    want = [(1, T), (2, U), (7, rows[4][1]), (None, rows[6][1]), (8, None), (8, None), (9, "")]
    assert got == sorted((str(i), str(t)) for i, t in want)


def test_toxicity_keeps_clean_rows(spark, folder):
    rows = [(i, f"{TOXIC} {i % 7}" if i % 2 else f"the calm river passes the old mill number {i % 7}") for i in range(40)] + [(None, None), (100, "")]
    got = corpus_pipeline.toxicity(spark, docs_of(spark, rows), folder)
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    kept = {r.doc_id for r in got.collect()}
    assert kept >= set(range(0, 40, 2)) and not kept & set(range(1, 40, 2))


def test_line_dedup_stage(spark, folder):
    line = "this line of ordinary words appears in many documents"
    rows = [(1, f"{line}\nfirst own line here"), (2, f"{line}\nsecond own line there"), (3, line), (4, None), (5, "")]
    got = {r.doc_id: r for r in corpus_pipeline.line_deduplication(spark, docs_of(spark, rows), folder).collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].text == "second own line there" and got[2].n_chars == len(got[2].text) and got[1].text == rows[0][1]


def test_decontamination_stage(spark, folder):
    passage = " ".join(f"exam{i}" for i in range(30))
    rows = [(1, passage), (1, "clean words of the same id"), (2, None), (3, "")]
    got = sorted((r.doc_id, str(r.text)) for r in corpus_pipeline.decontamination(spark, docs_of(spark, rows), folder).collect())
    assert got == [(1, "clean words of the same id"), (2, "None"), (3, "")]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_empty_tables(spark, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, docs_of(spark, [(1, T)]).limit(0), folder).count() == 0


def test_run_packs_what_is_kept(spark, tmp_path, folder):
    d = str(tmp_path)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    rows = [(100 + i, " ".join(f"w{i}x{j}" for j in range(20 + i))) for i in range(20)] + [(200, T), (201, T), (202, None)]
    docs_of(spark, rows).write.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {i for i, _ in rows} - {201}
    assert got.groupBy("bin_id").agg((F.sum("n_tokens") <= F.first("bin_size")).alias("ok")).where("not ok").isEmpty()


def test_workers_keep_few_words():
    """What a worker keeps from one stage to the next is bounded: its word hashes are some ten MB, however many words the texts have."""
    from plumeledger.llm import decontaminate, jaccard_join

    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(150)]
    before = [s.tolist() for s in jaccard_join.shingle_sets(texts[:3])]
    jaccard_join.shingle_sets(texts)
    assert len(jaccard_join._HASHES) <= 1 << 16
    index = decontaminate.BenchmarkIndex([("b", texts[149][:100])])
    got = index.scan(texts)
    assert len(index.hashes) <= 1 << 16
    assert [s.tolist() for s in jaccard_join.shingle_sets(texts[:3])] == before
    assert [sorted(x) for _, _, x in got] == [[]] * 149 + [["b"]]
