"""The queries of this subpackage, and SQL for those that it can express."""

from riskloom.llm.decontaminate import OP5_SQL, op5_decontaminate
from riskloom.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from riskloom.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from riskloom.llm.jaccard_join import OP4_SQL, op4_jaccard_join
from riskloom.llm.language import op7_language
from riskloom.llm.language_model import op9_lm_scoring
from riskloom.llm.merkle import OP11_SQL, op11_merkle
from riskloom.llm.packing import op2_packing
from riskloom.llm.quality import op3_quality
from riskloom.llm.secrets import OP12_SQL, op12_secrets
from riskloom.llm.sharding import op10_sharding
from riskloom.llm.token_counts import op6_token_counts
from riskloom.llm.token_files import op8_token_files

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_quality, op4_jaccard_join, op5_decontaminate, op6_token_counts, op7_language, op8_token_files, op9_lm_scoring, op10_sharding, op11_merkle, op12_secrets, op13_hard_negatives)}
SQL = {"op1_exact_dedup": OP1_SQL, "op4_jaccard_join": OP4_SQL, "op5_decontaminate": OP5_SQL, "op11_merkle": OP11_SQL, "op12_secrets": OP12_SQL, "op13_hard_negatives": OP13_SQL}
