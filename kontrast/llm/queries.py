"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import decontamination, line_dedup, warc
from .class_lm import op9_class_lm
from .decontamination import op7_decontamination
from .jaccard_join import op1_jaccard_join
from .line_dedup import op3_line_dedup
from .mixing import op5_mix_sources
from .neighbours import op6_nearest_neighbours
from .pii import op2_personal_data
from .quality import op8_quality_classifier
from .token_counts import op10_token_counts
from .warc import op4_warc_round_trip

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_personal_data": op2_personal_data,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_mix_sources": op5_mix_sources,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_decontamination": op7_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_class_lm": op9_class_lm,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_warc_round_trip": warc.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
}
