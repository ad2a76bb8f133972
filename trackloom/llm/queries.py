"""The text operators' queries, by name, and the SQL of those that DuckDB can express."""

from . import conversation_repair, decontaminate, katz_lm, language, pieces, quality, ranked_search, secrets, simhash, site_tree, substring_dedup, toxicity, warc

QUERIES = {
    "op1_main_text": site_tree.op1_main_text,
    "op2_secrets": secrets.op2_secrets,
    "op3_pieces": pieces.op3_pieces,
    "op4_language": language.op4_language,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_katz_lm": katz_lm.op9_katz_lm,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_warc": warc.op13_warc,
}
SQL = {
    "op6_decontaminate": decontaminate.SQL,
    "op7_quality": quality.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op11_ranked_search": ranked_search.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_warc": warc.SQL,
}
