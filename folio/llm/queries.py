"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from folio.llm.chat import OP6_SQL, op6_tool_call_linking
from folio.llm.fingerprint import op10_edit_fingerprints
from folio.llm.html import op7_html_extraction
from folio.llm.linededup import OP12_SQL, op12_line_dedup
from folio.llm.metric_join import op2_metric_range_join
from folio.llm.mixing import op8_source_mix
from folio.llm.negatives import OP13_SQL, op13_hard_negatives
from folio.llm.packing import op3_best_fit_packing
from folio.llm.secrets import op4_secret_scans
from folio.llm.simhash import op9_simhash_near_dedup
from folio.llm.suffix_tree import op5_suffix_tree_scores
from folio.llm.toxicity import op1_toxicity
from folio.llm.whitening import op11_feast_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_metric_range_join": op2_metric_range_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scans": op4_secret_scans,
    "op5_suffix_tree_scores": op5_suffix_tree_scores,
    "op6_tool_call_linking": op6_tool_call_linking,
    "op7_html_extraction": op7_html_extraction,
    "op8_source_mix": op8_source_mix,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_edit_fingerprints": op10_edit_fingerprints,
    "op11_feast_whitening": op11_feast_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op6_tool_call_linking": OP6_SQL, "op12_line_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
