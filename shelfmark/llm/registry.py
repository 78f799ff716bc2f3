"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP7_SQL, op7_decontamination
from .infill import OP12_SQL, op12_infill
from .language import op6_language
from .lines import OP9_SQL, op9_line_dedup
from .merkle import OP13_SQL, op13_manifest
from .neighbours import op4_nearest
from .packing import op3_packing
from .quality import op8_quality
from .sharding import op1_sharding
from .simhash import op5_simhash
from .substrings import op10_substrings
from .tokens import op2_token_counts
from .toxicity import op11_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_nearest": op4_nearest,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_substrings": op10_substrings,
    "op11_toxicity": op11_toxicity,
    "op12_infill": op12_infill,
    "op13_manifest": op13_manifest,
}
SQL = {
    "op7_decontamination": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op12_infill": OP12_SQL,
    "op13_manifest": OP13_SQL,
}
