"""The queries of this subpackage and the SQL that they must agree with."""

from __future__ import annotations

from .decontaminate import op1_decontaminate
from .lines import op3_line_dedup
from .media import op4_media_columns
from .minhash import op2_minhash
from .mixing import OP7_SQL, op7_mix_sources
from .pii import op10_pii
from .quality import op6_quality
from .sharding import op9_stratified_shards
from .substring import OP8_SQL, op8_substring
from .token_output import op5_training_order

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_minhash, op3_line_dedup, op4_media_columns, op5_training_order, op6_quality, op7_mix_sources, op8_substring, op9_stratified_shards, op10_pii)}
ORACLES = {"op7_mix_sources": OP7_SQL, "op8_substring": OP8_SQL}
