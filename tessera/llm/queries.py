"""The registered queries of the corpus operators and their SQL."""

from tessera.llm import chat, exact_dedup, licences
from tessera.llm.arrow_output import op9_arrow_output
from tessera.llm.chat import op1_chat_formatting
from tessera.llm.exact_dedup import op8_exact_dedup
from tessera.llm.html_text import op3_html_extraction
from tessera.llm.licences import op6_licence_scan
from tessera.llm.media import op7_media_columns
from tessera.llm.mixing import op4_mixing
from tessera.llm.near_dedup import op5_near_dedup
from tessera.llm.packing import op2_packing
from tessera.llm.toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_packing, op3_html_extraction, op4_mixing, op5_near_dedup, op6_licence_scan, op7_media_columns, op8_exact_dedup, op9_arrow_output, op10_toxicity)
}
ORACLES = {"op1_chat_formatting": chat.ORACLE, "op6_licence_scan": licences.oracle(), "op8_exact_dedup": exact_dedup.ORACLE}
