"""The corpus operators' queries, and SQL where SQL can express them."""

from sparkloom.llm import bpe, conversation_repair, fingerprints, jaccard_join, license_scan, line_dedup, mixing, phrase_mining, quality_classifier, quality_rules, suffix_dedup, url_filter, warc_zip

import corpus_pipeline

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_fingerprints": fingerprints.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_license_scan": license_scan.query,
    "op5_line_dedup": line_dedup.query,
    "op6_url_filter": url_filter.query,
    "op7_bpe": bpe.query,
    "op8_warc_zip": warc_zip.query,
    "op9_quality_rules": quality_rules.query,
    "op10_mixing": mixing.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_quality_classifier": quality_classifier.query,
    "op13_phrase_mining": phrase_mining.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_suffix_dedup": suffix_dedup.SQL, "op3_jaccard_join": jaccard_join.SQL, "op4_license_scan": license_scan.SQL, "op8_warc_zip": warc_zip.SQL, "op9_quality_rules": quality_rules.SQL, "op13_phrase_mining": phrase_mining.SQL}
