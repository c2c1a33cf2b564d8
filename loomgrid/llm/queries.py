"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from loomgrid.llm.bpe import op5_tree_bpe
from loomgrid.llm.langid import op6_hierarchical_langid
from loomgrid.llm.media import op1_mpeg_audio
from loomgrid.llm.mih import OP9_SQL, op9_incremental_mih
from loomgrid.llm.packing import op4_hierarchical_packing
from loomgrid.llm.sharding import op8_rendezvous_sharding
from loomgrid.llm.simhash import op3_pigeonring_simhash
from loomgrid.llm.suffix import op2_suffix_dedup
from loomgrid.llm.urlfilter import OP7_SQL, op7_temporal_list_join
from loomgrid.llm.warc import OP10_SQL, op10_merkle_fixity

QUERIES = {
    "op1_mpeg_audio": op1_mpeg_audio,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pigeonring_simhash": op3_pigeonring_simhash,
    "op4_hierarchical_packing": op4_hierarchical_packing,
    "op5_tree_bpe": op5_tree_bpe,
    "op6_hierarchical_langid": op6_hierarchical_langid,
    "op7_temporal_list_join": op7_temporal_list_join,
    "op8_rendezvous_sharding": op8_rendezvous_sharding,
    "op9_incremental_mih": op9_incremental_mih,
    "op10_merkle_fixity": op10_merkle_fixity,
}

ORACLES = {"op7_temporal_list_join": OP7_SQL, "op9_incremental_mih": OP9_SQL, "op10_merkle_fixity": OP10_SQL}
