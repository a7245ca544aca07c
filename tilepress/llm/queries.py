"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tilepress.llm.bpe import op3_bpe
from tilepress.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from tilepress.llm.fingerprints import op2_imatch
from tilepress.llm.lm import OP6_SQL, op6_stupid_backoff
from tilepress.llm.mixing import op1_mix_sources
from tilepress.llm.near_dedup import OP8_SQL, op8_near_dedup
from tilepress.llm.quality import op5_quality
from tilepress.llm.secrets import OP7_SQL, op7_secrets
from tilepress.llm.substring_dedup import op9_substring_dedup
from tilepress.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_imatch": op2_imatch,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_stupid_backoff": op6_stupid_backoff,
    "op7_secrets": op7_secrets,
    "op8_near_dedup": op8_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}
#: For the others see their tests: brute force, exact round trips or held-out accuracy.
SQL = {"op6_stupid_backoff": OP6_SQL, "op7_secrets": OP7_SQL, "op8_near_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL}
