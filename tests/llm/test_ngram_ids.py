"""Language-model scores whatever whole-number type the ids have."""

from plumeledger.llm import ngram_trie


def test_scores_of_int_ids_equal_those_of_long_ids(spark):
    rows = [(i, f"some words here {i % 4} and more", "x") for i in range(40)] + [(None, "words", "y"), (40, None, "z"), (40, "", "z")]
    text = "text string, score string"  # a further column with the name of a result
    got = [sorted(map(str, ngram_trie.lm_scores(spark.createDataFrame(rows, f"doc_id {t}, {text}")).collect())) for t in ("int", "long", "smallint")]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
