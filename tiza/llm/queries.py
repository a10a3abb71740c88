"""The subpackage's queries and their SQL, by name."""

from tiza.llm import byte_bpe, hard_negatives, language_id, lz_fingerprint, mixing, ngram_join, pii, quality_rules, repeated_spans, resharding, spelling_variants, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_language_id": language_id.op3_language_id,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_repeated_spans": repeated_spans.op5_repeated_spans,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_lz_fingerprint": lz_fingerprint.op8_lz_fingerprint,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_warc": warc.op10_warc,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_resharding": resharding.op13_resharding,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_ngram_join": ngram_join.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
