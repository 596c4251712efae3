"""The queries of this subpackage and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from rewardloom.llm import manifest, rules, substrings, warc
from rewardloom.llm.decontaminate import op6_decontamination
from rewardloom.llm.extraction import op4_html_extraction
from rewardloom.llm.manifest import op12_manifest
from rewardloom.llm.packing import op3_best_fit_packing
from rewardloom.llm.pieces import op11_sentencepiece
from rewardloom.llm.quality import op5_quality_classifier
from rewardloom.llm.rules import op10_quality_rules
from rewardloom.llm.scoring import op8_lm_scoring
from rewardloom.llm.sharding import op7_sharding
from rewardloom.llm.simhash import op9_simhash
from rewardloom.llm.substrings import op1_substring_dedup
from rewardloom.llm.warc import op2_warc
from rewardloom.llm.whitening import op13_whitening

QUERIES: dict[str, Callable] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_manifest": op12_manifest,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": substrings.SQL,
    "op2_warc": warc.SQL,
    "op10_quality_rules": rules.sql(),
    "op12_manifest": manifest.sql(),
}
