"""The subpackage's queries and, where SQL can express them, their DuckDB texts."""

from .decontam import OP1_SQL, op1_decontamination
from .embed import op8_embeddings
from .langid import op6_language
from .license import OP2_SQL, op2_licenses
from .merkle import OP10_SQL, op10_merkle_audit
from .mixing import op3_mixing
from .ngram import op9_ngram
from .simhash import op4_simhash
from .suffix import op7_suffix
from .toxicity import op5_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_suffix": op7_suffix,
    "op8_embeddings": op8_embeddings,
    "op9_ngram": op9_ngram,
    "op10_merkle_audit": op10_merkle_audit,
}
SQL = {"op2_licenses": OP2_SQL, "op1_decontamination": OP1_SQL, "op10_merkle_audit": OP10_SQL}
