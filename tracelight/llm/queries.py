"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op13_tokenizer_alignment
from .decontamination import OP11_SQL, op11_decontamination
from .line_dedup import op5_line_dedup
from .mixing import OP9_SQL, op9_mix_sources
from .neighbours import op1_nearest_neighbours
from .packing import op2_best_fit_packing
from .quality import OP3_SQL, op3_quality_rules
from .repair import op12_conversation_repair
from .simhash import op7_simhash_near_dedup
from .token_files import op8_token_files
from .toxicity import op4_toxicity
from .url_filter import op6_url_filter
from .warc import OP10_SQL, op10_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_best_fit_packing, op3_quality_rules, op4_toxicity, op5_line_dedup, op6_url_filter, op7_simhash_near_dedup, op8_token_files, op9_mix_sources, op10_warc,
        op11_decontamination, op12_conversation_repair, op13_tokenizer_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op9_mix_sources": OP9_SQL, "op10_warc": OP10_SQL, "op11_decontamination": OP11_SQL}
