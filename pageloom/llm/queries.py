"""Queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from pageloom.llm.collocations import OP11_SQL, op11_collocations
from pageloom.llm.divergence import OP13_SQL, op13_divergence
from pageloom.llm.itq import OP7_SQL, op7_embedding_dedup
from pageloom.llm.langid import op3_language
from pageloom.llm.minhash import op5_minhash
from pageloom.llm.mixing import OP6_SQL, op6_mixing
from pageloom.llm.packing import op9_packing
from pageloom.llm.quality import op10_quality
from pageloom.llm.secrets import OP8_SQL, op8_secrets
from pageloom.llm.sharding import OP4_SQL, op4_sharding
from pageloom.llm.substrings import OP2_SQL, op2_substrings
from pageloom.llm.topk import OP1_SQL, op1_top_k
from pageloom.llm.urlfilter import op12_url_filter

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_substrings": op2_substrings,
    "op3_language": op3_language,
    "op4_sharding": op4_sharding,
    "op5_minhash": op5_minhash,
    "op6_mixing": op6_mixing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_url_filter": op12_url_filter,
    "op13_divergence": op13_divergence,
}
SQL = {
    "op1_top_k": OP1_SQL,
    "op2_substrings": OP2_SQL,
    "op4_sharding": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_secrets": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op13_divergence": OP13_SQL,
}
