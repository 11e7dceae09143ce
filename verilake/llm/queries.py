"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from verilake.llm.bpe import op10_bpe_transducer
from verilake.llm.fingerprints import op7_bottom_k
from verilake.llm.langid import op4_output_codes
from verilake.llm.licenses import op8_window_bands
from verilake.llm.linedup import OP2_SQL, op2_set_similarity_join
from verilake.llm.merkle import OP11_SQL, op11_sibling_shift_manifest
from verilake.llm.neardup import OP1_SQL, op1_superminhash
from verilake.llm.packing import op9_multi_length_packing
from verilake.llm.quality import op13_compression_bands
from verilake.llm.sharding import op5_virtual_slots
from verilake.llm.substrings import op6_content_defined_chunks
from verilake.llm.topk import OP3_SQL, op3_uniform_threshold
from verilake.llm.whitening import op12_householder_whitening

QUERIES = {f.__name__: f for f in (op1_superminhash, op2_set_similarity_join, op3_uniform_threshold, op4_output_codes, op5_virtual_slots, op6_content_defined_chunks, op7_bottom_k, op8_window_bands, op9_multi_length_packing, op10_bpe_transducer, op11_sibling_shift_manifest, op12_householder_whitening, op13_compression_bands)}

ORACLES: dict[str, str] = {"op1_superminhash": OP1_SQL, "op2_set_similarity_join": OP2_SQL, "op3_uniform_threshold": OP3_SQL, "op11_sibling_shift_manifest": OP11_SQL}
