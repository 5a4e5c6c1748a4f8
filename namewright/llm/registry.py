"""The subpackage's queries and their SQL, added by ``__spark_entry__.py``."""

from __future__ import annotations

from namewright.llm.align import op12_token_alignment
from namewright.llm.bytebpe import op13_byte_bpe
from namewright.llm.exactdedup import OP4_SQL, op4_exact_dedup
from namewright.llm.langid import op6_language_id
from namewright.llm.mixing import op9_mixing
from namewright.llm.packing import op10_packing
from namewright.llm.quality import op7_quality_rules
from namewright.llm.secrets import op1_secret_scan
from namewright.llm.simhash import op8_simhash
from namewright.llm.suffix import op5_suffix_dedup
from namewright.llm.tokenstore import op3_token_output
from namewright.llm.toxicity import op2_toxicity
from namewright.llm.veccodes import op11_vector_codes

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_token_output, op4_exact_dedup, op5_suffix_dedup, op6_language_id, op7_quality_rules, op8_simhash, op9_mixing, op10_packing, op11_vector_codes, op12_token_alignment, op13_byte_bpe)}
ORACLES = {"op4_exact_dedup": OP4_SQL}
