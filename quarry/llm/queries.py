"""The registered queries of this folder and their SQL."""

from quarry.llm import chat, quality_rules
from quarry.llm.chat import op6_chat_formatting
from quarry.llm.decontaminate import op1_benchmark_decontamination
from quarry.llm.language_id import op8_language_id
from quarry.llm.minhash_dedup import op10_minhash_near_dedup
from quarry.llm.quality_classifier import op2_quality_classifier
from quarry.llm.quality_rules import op7_quality_rules
from quarry.llm.secret_scan import op9_secret_scans
from quarry.llm.sentencepiece_codec import op4_sentencepiece
from quarry.llm.suffix_dedup import op5_suffix_array_dedup
from quarry.llm.toxicity import op3_toxicity


def queries():
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_quality_classifier, op3_toxicity, op4_sentencepiece, op5_suffix_array_dedup, op6_chat_formatting, op7_quality_rules, op8_language_id, op9_secret_scans, op10_minhash_near_dedup)}


def oracle_sql():
    return {"op6_chat_formatting": chat.OP6_SQL, "op7_quality_rules": quality_rules.OP7_SQL}
