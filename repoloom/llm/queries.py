"""Registered queries of the package and the SQL that checks them."""

from __future__ import annotations

from repoloom.llm.decontamination import op6_decontamination
from repoloom.llm.embedding_dedup import op5_embedding_near_dedup
from repoloom.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from repoloom.llm.licenses import OP2_SQL, op2_license_scan
from repoloom.llm.line_quality import op12_line_quality
from repoloom.llm.packing import op9_packing
from repoloom.llm.periodic_runs import op13_periodic_runs
from repoloom.llm.replies import OP7_SQL, op7_chat_format
from repoloom.llm.simhash import op10_simhash_near_dedup
from repoloom.llm.suffix_dedup import op8_suffix_dedup
from repoloom.llm.token_counts import op4_token_counts
from repoloom.llm.token_files import op3_token_files
from repoloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_chat_format": op7_chat_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_quality": op12_line_quality,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": OP2_SQL,
    "op7_chat_format": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
}
