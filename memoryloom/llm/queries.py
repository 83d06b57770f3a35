"""Queries of the operators for training data, and the SQL of those that have one."""

from __future__ import annotations

from memoryloom.llm.bytebpe import op12_bytebpe
from memoryloom.llm.hostrules import op10_hostrules
from memoryloom.llm.language import op5_language
from memoryloom.llm import centroids, hostrules, licences, negatives, topk
from memoryloom.llm.lines import op3_lines
from memoryloom.llm.packing import op4_packing
from memoryloom.llm.pieces import op9_sentencepiece
from memoryloom.llm.quality import op1_quality
from memoryloom.llm.secrets import op8_secrets
from memoryloom.llm.simhash import op2_simhash

QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash, op3_lines, op4_packing, op5_language, topk.op6_topk, licences.op7_licences, op8_secrets, op9_sentencepiece, op10_hostrules, centroids.op11_centroids, op12_bytebpe, negatives.op13_negatives)}
ORACLE_SQL: dict[str, str] = {"op6_topk": topk.ORACLE_SQL, "op7_licences": licences.ORACLE_SQL, "op10_hostrules": hostrules.ORACLE_SQL, "op11_centroids": centroids.ORACLE_SQL, "op13_negatives": negatives.ORACLE_SQL}
