"""The queries of this package and the SQL of those that SQL can express."""

from mnemis.llm.ann import op3_multi_index_hashing
from mnemis.llm.bpe import op7_bpe_round_trip
from mnemis.llm.chat import ORACLE as CHAT_SQL
from mnemis.llm.chat import op9_chat_format
from mnemis.llm.classifier import op4_random_indexing_quality
from mnemis.llm.packing import op10_sum_of_squares_packing
from mnemis.llm.pii import op5_weak_supervision_pii
from mnemis.llm.quality import ORACLE as QUALITY_SQL
from mnemis.llm.quality import op1_quality_rules
from mnemis.llm.sharding import ORACLE as SHARDING_SQL
from mnemis.llm.sharding import op8_rendezvous_sharding
from mnemis.llm.simhash import op6_simhash_classes
from mnemis.llm.substring import ORACLE as SUBSTRING_SQL
from mnemis.llm.substring import op2_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_substring_dedup, op3_multi_index_hashing, op4_random_indexing_quality, op5_weak_supervision_pii,
        op6_simhash_classes, op7_bpe_round_trip, op8_rendezvous_sharding, op9_chat_format, op10_sum_of_squares_packing,
    )
}
ORACLES = {"op1_quality_rules": QUALITY_SQL, "op2_substring_dedup": SUBSTRING_SQL, "op8_rendezvous_sharding": SHARDING_SQL, "op9_chat_format": CHAT_SQL}
