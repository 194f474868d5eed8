"""Queries and SQL of this subpackage, for the registry at the repository top."""

from bytelore.functions.batches import in_small_batches
from bytelore.llm import divergence, sharding, urls
from bytelore.llm.decontamination import op6_decontamination
from bytelore.llm.divergence import op13_divergence
from bytelore.llm.fingerprints import op3_fingerprints
from bytelore.llm.language import op10_language
from bytelore.llm.near_copies import op7_near_copies
from bytelore.llm.pages import op8_pages
from bytelore.llm.personal import op2_personal
from bytelore.llm.pieces import op9_pieces
from bytelore.llm.recurrent import op11_recurrent
from bytelore.llm.repair import op12_repair
from bytelore.llm.secrets import op1_secrets
from bytelore.llm.sharding import op5_sharding
from bytelore.llm.urls import op4_urls


def queries() -> dict:
    found = (op1_secrets, op2_personal, op3_fingerprints, op4_urls, op5_sharding, op6_decontamination, op7_near_copies, op8_pages, op9_pieces, op10_language, op11_recurrent, op12_repair, op13_divergence)
    return {q.__name__: in_small_batches(q) for q in found}


def oracle_sql() -> dict[str, str]:
    return {**urls.ORACLE, **sharding.ORACLE, **divergence.ORACLE}
