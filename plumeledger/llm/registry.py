"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import functools

from plumeledger.llm.collocations import op12_collocations
from plumeledger.llm.conversation_repair import op13_conversation_repair
from plumeledger.llm.decontaminate import op8_decontaminate
from plumeledger.llm.fingerprints import op3_fingerprints
from plumeledger.llm.html_extract import op5_html_extract
from plumeledger.llm.jaccard_join import op9_jaccard_join
from plumeledger.llm.line_dedup import op1_line_dedup
from plumeledger.llm.ngram_trie import op7_ngram_trie
from plumeledger.llm.packing import op6_best_fit_packing
from plumeledger.llm.sharding import op11_stratified_shards
from plumeledger.llm.shared import importable
from plumeledger.llm.token_records import op2_token_records
from plumeledger.llm.toxicity import op4_toxicity
from plumeledger.llm.warc_records import op10_warc_chunks


QUERIES = (op1_line_dedup, op2_token_records, op3_fingerprints, op4_toxicity, op5_html_extract, op6_best_fit_packing, op7_ngram_trie, op8_decontaminate, op9_jaccard_join, op10_warc_chunks, op11_stratified_shards, op12_collocations, op13_conversation_repair)


def _ready(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        importable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {f.__name__: _ready(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from plumeledger.llm import oracles

    return dict(oracles.SQL)
