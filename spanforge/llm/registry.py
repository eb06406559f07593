"""Queries and SQL of this subpackage, under the names that the entry module registers."""

from __future__ import annotations

from spanforge.llm.balls import OP13_SQL, op13_balls
from spanforge.llm.bytebpe import op11_bytebpe
from spanforge.llm.chat import OP9_SQL, op9_snapshots
from spanforge.llm.fertility import op1_fertility
from spanforge.llm.language import op4_language
from spanforge.llm.lattice import op2_gumbel
from spanforge.llm.minhash import OP7_SQL, op7_minmax
from spanforge.llm.packing import op8_packing
from spanforge.llm.passages import op6_passages
from spanforge.llm.sharding import op5_rendezvous
from spanforge.llm.shards import op3_training_order
from spanforge.llm.variants import OP12_SQL, op12_variants
from spanforge.llm.vectors import OP10_SQL, op10_hnsw

QUERIES = {
    "op1_fertility": op1_fertility,
    "op2_gumbel": op2_gumbel,
    "op3_training_order": op3_training_order,
    "op4_language": op4_language,
    "op5_rendezvous": op5_rendezvous,
    "op6_passages": op6_passages,
    "op7_minmax": op7_minmax,
    "op8_packing": op8_packing,
    "op9_snapshots": op9_snapshots,
    "op10_hnsw": op10_hnsw,
    "op11_bytebpe": op11_bytebpe,
    "op12_variants": op12_variants,
    "op13_balls": op13_balls,
}

ORACLE_SQL: dict[str, str] = {"op7_minmax": OP7_SQL, "op9_snapshots": OP9_SQL, "op10_hnsw": OP10_SQL, "op12_variants": OP12_SQL, "op13_balls": OP13_SQL}
