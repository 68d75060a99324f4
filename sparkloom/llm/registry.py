"""Queries of this subpackage and, where SQL can express one, their SQL."""

from __future__ import annotations

from sparkloom.llm.ann import op2_ivf_pq
from sparkloom.llm.ballkmeans import op11_ball_kmeans
from sparkloom.llm.chat import op1_chat_windows
from sparkloom.llm.decontam import op4_decontamination
from sparkloom.llm.fim import op12_fill_in_middle
from sparkloom.llm.langid import op3_language_id
from sparkloom.llm.mixture import op9_mixture
from sparkloom.llm.neardup import op10_minhash_components
from sparkloom.llm.oracles import ORACLES
from sparkloom.llm.ppm import op8_ppm_scores
from sparkloom.llm.resharding import op13_reshard
from sparkloom.llm.secrets import op5_secrets
from sparkloom.llm.tokencount import op6_token_counts
from sparkloom.llm.tokenids import op7_token_ids

QUERIES = {f.__name__: f for f in (
    op1_chat_windows, op2_ivf_pq, op3_language_id, op4_decontamination, op5_secrets, op6_token_counts, op7_token_ids, op8_ppm_scores, op9_mixture, op10_minhash_components,
    op11_ball_kmeans, op12_fill_in_middle, op13_reshard,
)}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
