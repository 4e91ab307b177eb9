"""The queries of the training-data operators, and their SQL where SQL can state the result."""

from __future__ import annotations

from .collocations import SQL as COLLOCATION_SQL
from .collocations import op12_collocations
from .filteraudit import SQL as AUDIT_SQL
from .filteraudit import op11_filter_audit
from .hamming import SQL as HAMMING_SQL
from .hamming import op4_hamming_topk
from .htmltext import op10_html_text
from .mixing import op6_source_mix
from .packing import op1_curve_packing
from .pii import op2_pii_spans
from .rulelist import op13_quality_rules
from .setjoin import op9_jaccard_join
from .substrings import op8_repeated_substrings
from .toxicity import op5_toxicity
from .vectors import op3_near_vectors
from .warc import op7_warc_index

QUERIES = {f.__name__: f for f in (op1_curve_packing, op2_pii_spans, op3_near_vectors, op4_hamming_topk, op5_toxicity, op6_source_mix, op7_warc_index, op8_repeated_substrings, op9_jaccard_join, op10_html_text, op11_filter_audit, op12_collocations, op13_quality_rules)}
ORACLE_SQL = {"op4_hamming_topk": HAMMING_SQL, "op11_filter_audit": AUDIT_SQL, "op12_collocations": COLLOCATION_SQL}
