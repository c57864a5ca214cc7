"""Registered queries of this folder and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from tablewright.llm.decontamination import OP3_SQL, op3_decontamination
from tablewright.llm.exact_topk import OP13_SQL, op13_exact_topk
from tablewright.llm.filter_audit import OP12_SQL, op12_filter_audit
from tablewright.llm.jaccard_join import OP10_SQL, op10_ngram_jaccard
from tablewright.llm.language import op9_language_mixture
from tablewright.llm.licences import op7_licence_scan
from tablewright.llm.line_dedup import op2_fuzzy_lines
from tablewright.llm.neighbours import op5_nearest_neighbours
from tablewright.llm.packing import op6_best_fit_packing
from tablewright.llm.surrogates import op4_surrogates
from tablewright.llm.token_counts import op8_edit_token_counts
from tablewright.llm.toxicity import op1_toxicity_segments
from tablewright.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_toxicity_segments": op1_toxicity_segments,
    "op2_fuzzy_lines": op2_fuzzy_lines,
    "op3_decontamination": op3_decontamination,
    "op4_surrogates": op4_surrogates,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_licence_scan": op7_licence_scan,
    "op8_edit_token_counts": op8_edit_token_counts,
    "op9_language_mixture": op9_language_mixture,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_exact_topk": op13_exact_topk,
}
SQL: dict[str, str] = {
    "op3_decontamination": OP3_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_filter_audit": OP12_SQL,
    "op13_exact_topk": OP13_SQL,
}
