"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontaminate
from .jaccard import OP5_SQL, op5_jaccard_join
from .language import op7_language
from .licenses import op3_licenses
from .lm import op6_lm
from .mixing import op8_mix
from .pii import op9_pii
from .repetition import OP2_SQL, op2_repetition
from .secrets import op4_secrets
from .sharding import OP10_SQL, op10_shard
from .toxicity import op11_toxicity
from .trie import OP12_SQL, op12_prefix_trie
from .whitening import op13_whitening


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_repetition, op3_licenses, op4_secrets, op5_jaccard_join, op6_lm, op7_language, op8_mix, op9_pii, op10_shard, op11_toxicity, op12_prefix_trie, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_repetition": OP2_SQL, "op5_jaccard_join": OP5_SQL, "op10_shard": OP10_SQL, "op12_prefix_trie": OP12_SQL}
