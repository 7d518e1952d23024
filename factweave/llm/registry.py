"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from factweave.llm import cover_tree, decontamination, line_rules
from factweave.llm.cover_tree import op11_cover_tree
from factweave.llm.decontamination import op8_containment_search
from factweave.llm.language_model import op3_attention_scores
from factweave.llm.line_rules import op6_line_frequency
from factweave.llm.near_join import op9_lsh_forest
from factweave.llm.packing import op4_concatenate_and_cut
from factweave.llm.quality import op5_pairwise_ranking
from factweave.llm.secrets import op1_secret_field
from factweave.llm.sharding import op7_virtual_slots
from factweave.llm.tokens import op2_digest_cache
from factweave.llm.toxicity import op10_noisy_or
from factweave.llm.turns import op12_block_tables
from factweave.llm.whitening import op13_qdwh_whitening


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_field, op2_digest_cache, op3_attention_scores, op4_concatenate_and_cut, op5_pairwise_ranking, op6_line_frequency, op7_virtual_slots, op8_containment_search, op9_lsh_forest, op10_noisy_or, op11_cover_tree, op12_block_tables, op13_qdwh_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_frequency": line_rules.SQL, "op8_containment_search": decontamination.SQL, "op11_cover_tree": cover_tree.SQL}
