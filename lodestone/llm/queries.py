"""The queries of this subpackage and, where SQL can express one, the SQL for the same rows."""

from lodestone.llm.decontamination import OP6_SQL, op6_decontamination
from lodestone.llm.extraction import op5_extraction
from lodestone.llm.importance import OP12_SQL, op12_resampling
from lodestone.llm.licences import OP1_SQL, op1_licences
from lodestone.llm.merkle import OP13_SQL, op13_manifest
from lodestone.llm.near_vectors import OP8_SQL, op8_near_vectors
from lodestone.llm.ngram_join import op4_ngram_join
from lodestone.llm.packing import op2_packing
from lodestone.llm.quality import op7_quality
from lodestone.llm.repacking import op11_repacking
from lodestone.llm.secrets import op9_secrets
from lodestone.llm.toxicity import op10_toxicity
from lodestone.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    f.__name__: f
    for f in (op1_licences, op2_packing, op3_warc, op4_ngram_join, op5_extraction, op6_decontamination, op7_quality, op8_near_vectors, op9_secrets, op10_toxicity, op11_repacking, op12_resampling, op13_manifest)
}
SQL = {"op1_licences": OP1_SQL, "op3_warc": OP3_SQL, "op6_decontamination": OP6_SQL, "op8_near_vectors": OP8_SQL, "op12_resampling": OP12_SQL, "op13_manifest": OP13_SQL}
