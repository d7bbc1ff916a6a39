"""The registered queries of this subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from seqloom.llm import exact, linededup
from seqloom.llm.exact import op6_exact_dedup
from seqloom.llm.langid import op1_language_id
from seqloom.llm.linededup import op2_line_dedup
from seqloom.llm.minhash import op4_minhash_dedup
from seqloom.llm.mixing import op8_source_mixing
from seqloom.llm.packing import op7_best_fit_packing
from seqloom.llm.pii import op9_pii
from seqloom.llm.quality import op3_quality_rules
from seqloom.llm.secrets import op10_secret_scan
from seqloom.llm.substring import op5_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_line_dedup, op3_quality_rules, op4_minhash_dedup, op5_substring_dedup,
        op6_exact_dedup, op7_best_fit_packing, op8_source_mixing, op9_pii, op10_secret_scan,
    )
}
#: Where an operator has no SQL here, tests/llm hold it against a brute-force version.
ORACLES: dict[str, str] = {"op2_line_dedup": linededup.OP2_SQL, "op6_exact_dedup": exact.OP6_SQL}
