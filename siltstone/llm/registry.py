"""All queries of the subpackage and the SQL that some of them equal."""

from __future__ import annotations

from siltstone.llm import bagminhash, budget_mix, decontam_cgk, lang_crf, license_sam, lm_score, quality_rules, secret_markov, substring_dedup, warc_writer

MODULES = (warc_writer, lm_score, lang_crf, secret_markov, license_sam, decontam_cgk, quality_rules, substring_dedup, budget_mix, bagminhash)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
