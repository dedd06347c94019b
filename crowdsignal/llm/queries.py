"""The queries of the training-data operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL, run

from .alignment import op12_tokenizer_alignment
from .chat import OP6_SQL, op6_chat_format
from .decontaminate import op7_benchmark_leaks
from .fingerprints import op9_fingerprints
from .html_text import op10_html_text
from .licenses import OP11_SQL, op11_license_scan
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import OP5_SQL, op5_source_mixing
from .near_dup import op4_minhash_near_dup
from .packing import op2_token_packing
from .quality import op1_quality
from .secrets import op3_secret_scan
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_quality, op2_token_packing, op3_secret_scan, op4_minhash_near_dup, op5_source_mixing, op6_chat_format, op7_benchmark_leaks, op8_toxicity, op9_fingerprints, op10_html_text, op11_license_scan, op12_tokenizer_alignment, op13_merkle_manifest)} | {"pipeline": run}
ORACLES: dict[str, str] = {"op5_source_mixing": OP5_SQL, "op6_chat_format": OP6_SQL, "op11_license_scan": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
if ORACLE_SQL:
    ORACLES["pipeline"] = ORACLE_SQL
