"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op9
from .epsilon_grid import OP7_SQL, op7
from .language import op8
from .mixing import OP6_SQL, op6
from .quality import OP5_SQL, op5
from .quotes import OP1_SQL, op1
from .secrets import op4, op4_sql
from .simhash import op2
from .substrings import op3
from .toxicity import op10

QUERIES = {
    "op1_quote_linking": op1,
    "op2_simhash": op2,
    "op3_compact_windows": op3,
    "op4_trigram_secrets": op4,
    "op5_quality_rules": op5,
    "op6_mixture": op6,
    "op7_epsilon_grid": op7,
    "op8_language_id": op8,
    "op9_bpe_roundtrip": op9,
    "op10_toxicity": op10,
}
SQL: dict[str, str] = {"op1_quote_linking": OP1_SQL, "op4_trigram_secrets": op4_sql(), "op5_quality_rules": OP5_SQL, "op6_mixture": OP6_SQL, "op7_epsilon_grid": OP7_SQL}
