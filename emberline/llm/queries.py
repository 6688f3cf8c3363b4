"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import mixing, seekable_fim, warc_dictionary, winnowing
from .decision_lists import op13_decision_lists
from .feast_whitening import op11_feast_whitening
from .kd_shards import op4_kd_shards
from .kernel_toxicity import op8_kernel_toxicity
from .kneser_ney_langid import op2_kneser_ney_langid
from .prefix_hashes import op6_prefix_hashes
from .rule_quality import op7_rule_quality
from .separator_scan import op5_separator_scan
from .simhash_anchors import op3_simhash_anchors

QUERIES = {
    "op1_warc_dictionary": warc_dictionary.op1_warc_dictionary,
    "op2_kneser_ney_langid": op2_kneser_ney_langid,
    "op3_simhash_anchors": op3_simhash_anchors,
    "op4_kd_shards": op4_kd_shards,
    "op5_separator_scan": op5_separator_scan,
    "op6_prefix_hashes": op6_prefix_hashes,
    "op7_rule_quality": op7_rule_quality,
    "op8_kernel_toxicity": op8_kernel_toxicity,
    "op9_winnowing": winnowing.op9_winnowing,
    "op10_systematic_mix": mixing.op10_systematic_mix,
    "op11_feast_whitening": op11_feast_whitening,
    "op12_seekable_fim": seekable_fim.op12_seekable_fim,
    "op13_decision_lists": op13_decision_lists,
}

SQL: dict[str, str] = {
    "op1_warc_dictionary": warc_dictionary.SQL,
    "op9_winnowing": winnowing.SQL,
    "op10_systematic_mix": mixing.SQL,
    "op12_seekable_fim": seekable_fim.SQL,
}
