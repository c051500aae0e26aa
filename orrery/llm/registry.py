"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .hnsw import op8_nearest
from .jaccard import OP1_SQL, op1_jaccard_join, op1_jaccard_links
from .langid import op2_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import op7_mixing
from .packing import op4_packing
from .pii import op6_pii
from .quality import op5_quality
from .sharding import op3_sharding
from .substring import OP10_SQL, op10_substring_dedup

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_nearest": op8_nearest,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}

#: Queries beside the ten operators'.
MORE = {"op1_jaccard_links": op1_jaccard_links}

ORACLE_SQL = {
    "op1_jaccard_join": OP1_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
}
