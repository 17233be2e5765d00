"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from sigloom.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from sigloom.llm.fingerprints import op11_fingerprints
from sigloom.llm.html_extract import op3_html
from sigloom.llm.langid import op6_langid
from sigloom.llm.mixing import op4_mixing
from sigloom.llm.negatives import OP12_SQL, op12_hard_negatives
from sigloom.llm.packing import op9_packing
from sigloom.llm.phrases import OP13_SQL, op13_phrases
from sigloom.llm.pii import op7_pii
from sigloom.llm.quality import OP2_SQL, op2_quality
from sigloom.llm.sharding import op10_sharding
from sigloom.llm.simhash import op1_simhash
from sigloom.llm.substring import OP5_SQL, op5_substring


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality": op2_quality,
        "op3_html": op3_html,
        "op4_mixing": op4_mixing,
        "op5_substring": op5_substring,
        "op6_langid": op6_langid,
        "op7_pii": op7_pii,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
        "op11_fingerprints": op11_fingerprints,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op5_substring": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op12_hard_negatives": OP12_SQL, "op13_phrases": OP13_SQL}
