"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pdforge.llm import (block_names, byte_gru, eftrie_lm, hard_negatives, license_scan, line_spread, ngram_join, orc_tokens,
                         pack_nnls, phrase_tries, posting_ann, sentence_pieces, source_mix)
from pdforge.llm.common import documents


def _on_documents(fn):
    def run(spark, sf_dir):
        return fn(documents(spark, sf_dir))
    run.__name__ = fn.__module__.rsplit(".", 1)[-1]
    run.__doc__ = fn.__doc__
    return run


def _on_embeddings(fn):
    def run(spark, sf_dir):
        return fn(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    run.__name__ = fn.__module__.rsplit(".", 1)[-1]
    run.__doc__ = fn.__doc__
    return run


QUERIES = {
    "op1_license_scan": _on_documents(license_scan.query),
    "op2_ngram_join": _on_documents(ngram_join.query),
    "op3_eftrie_lm": _on_documents(eftrie_lm.query),
    "op4_pack_nnls": _on_documents(pack_nnls.query),
    "op5_line_spread": _on_documents(line_spread.query),
    "op6_block_names": _on_documents(block_names.query),
    "op7_posting_ann": _on_embeddings(posting_ann.query),
    "op8_byte_gru": _on_documents(byte_gru.query),
    "op9_source_mix": _on_documents(source_mix.query),
    "op10_orc_tokens": _on_documents(orc_tokens.query),
    "op11_hard_negatives": _on_embeddings(hard_negatives.query),
    "op12_phrase_tries": _on_documents(phrase_tries.query),
    "op13_sentence_pieces": _on_documents(sentence_pieces.query),
}

SQL = {
    "op5_line_spread": line_spread.SQL,
    "op6_block_names": block_names.SQL,
    "op9_source_mix": source_mix.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_phrase_tries": phrase_tries.SQL,
}
