"""Queries of the operators and their SQL twins, by name."""

from sigspark.llm import chat_format, decontaminate, langid, lines, neighbours, repeats, sentencepieces, simhash, toxicity, urls

QUERIES = {
    "op1_repeats": repeats.query,
    "op2_lines": lines.query,
    "op3_chat_format": chat_format.query,
    "op4_decontaminate": decontaminate.query,
    "op5_url_filter": urls.query,
    "op6_simhash": simhash.query,
    "op7_neighbours": neighbours.query,
    "op8_language_id": langid.query,
    "op9_toxicity": toxicity.query,
    "op10_sentencepiece": sentencepieces.query,
}
ORACLE_SQL = {
    "op1_repeats": repeats.SQL,
    "op3_chat_format": chat_format.SQL,
    "op4_decontaminate": decontaminate.SQL,
}
if simhash.SQL:
    ORACLE_SQL["op6_simhash"] = simhash.SQL
