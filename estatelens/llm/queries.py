"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import ORACLE_OP9, op9_benchmark_decontamination
from .language_id import op8_language_id
from .license_scan import op7_license_scan
from .line_dedup import ORACLE_OP6, op6_line_dedup
from .mixing import op1_mixing, oracle_op1
from .pii import op5_pii, oracle_op5
from .quality import ORACLE_OP2, op2_quality_rules
from .simhash import op3_simhash_near_dedup
from .toxicity import op4_toxicity
from .url_filter import op10_url_filters, oracle_op10

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_quality_rules,
        op3_simhash_near_dedup,
        op4_toxicity,
        op5_pii,
        op6_line_dedup,
        op7_license_scan,
        op8_language_id,
        op9_benchmark_decontamination,
        op10_url_filters,
    )
}


def oracles() -> dict[str, str]:
    return {"op1_mixing": oracle_op1(), "op2_quality_rules": ORACLE_OP2, "op5_pii": oracle_op5(), "op6_line_dedup": ORACLE_OP6, "op9_benchmark_decontamination": ORACLE_OP9, "op10_url_filters": oracle_op10()}
