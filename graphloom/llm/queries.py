"""The registered query of each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from . import decontaminate, language_model, lexical_search, license_scan, near_dup, quality_classifier, quality_rules, secret_scan, sentencepiece_sample, suffix_dedup, token_counts, url_filter, vector_codes
from .common import read

TOKENIZER_BYTE_BPE = "byte_bpe_50k.json"
TOKENIZER_PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def op4_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op5_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"), secret_scan.fit(spark))


def op6_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def op7_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary(TOKENIZER_BYTE_BPE))


def op9_sentencepiece_sample(spark, sf_dir):
    return sentencepiece_sample.sample_segmentations(read(spark, sf_dir, "documents"), vocabulary(TOKENIZER_PIECES), k=2, ids=False, digest=True)


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress_vectors(read(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_language_model(spark, sf_dir):
    return language_model.score_documents(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_decontaminate, op3_quality_rules, op4_url_filter, op5_secret_scan, op6_quality_classifier, op7_near_dup, op8_token_counts,
        op9_sentencepiece_sample, op10_suffix_dedup, op11_vector_codes, op12_lexical_search, op13_language_model,
    )
}
ORACLE_SQL = {
    "op4_url_filter": url_filter.ORACLE,
    "op7_near_dup": near_dup.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
