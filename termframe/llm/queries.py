"""The queries of this subpackage and, where SQL can say it, their SQL."""

from termframe.llm.bm25 import SQL as SEARCH_SQL
from termframe.llm.bm25 import op10_bm25_search
from termframe.llm.decontamination import op8_decontamination
from termframe.llm.language_id import op5_language_id
from termframe.llm.line_dedup import SQL as LINE_SQL
from termframe.llm.line_dedup import op1_line_dedup
from termframe.llm.minhash_dedup import SQL as NEAR_SQL
from termframe.llm.minhash_dedup import op6_minhash_dedup
from termframe.llm.pii import op2_pii
from termframe.llm.quality import op7_quality
from termframe.llm.sentencepiece_codec import op4_sentencepiece
from termframe.llm.suffix_dedup import op3_suffix_dedup
from termframe.llm.token_files import op9_token_files

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_bm25_search": op10_bm25_search,
}
ORACLE_SQL = {"op1_line_dedup": LINE_SQL, "op6_minhash_dedup": NEAR_SQL, "op10_bm25_search": SEARCH_SQL}
