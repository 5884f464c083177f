"""Registered queries of this subpackage: each operator over its whole table."""

from .bpe import op5_bpe
from .chat import op4_chat
from .decontamination import op3_decontaminate
from .html_blocks import op10_html_extract
from .language_id import op7_language_id
from .near_dedup import op8_near_dedup
from .neighbours import op2_neighbours
from .quality import op6_quality
from .token_counts import op1_token_counts
from .url_filter import op9_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_neighbours": op2_neighbours,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat": op4_chat,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_near_dedup": op8_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_html_extract": op10_html_extract,
}
ORACLES: dict[str, str] = {}
