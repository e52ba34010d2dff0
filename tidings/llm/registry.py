"""The subpackage's queries and their SQL, which __spark_entry__.py adds to those of the library."""

from tidings.llm import bpe, conversations, language_id, lattice_lm, merkle, ngram_join, quality_gam, quality_rules, repeats, source_mix, token_store, top_k, url_filters


def queries() -> dict:
    return {
        "op1_token_store": token_store.query,
        "op2_quality_gam": quality_gam.query,
        "op3_lattice_lm": lattice_lm.query,
        "op4_ngram_join": ngram_join.query,
        "op5_quality_rules": quality_rules.query,
        "op6_bpe": bpe.query,
        "op7_repeats": repeats.query,
        "op8_source_mix": source_mix.query,
        "op9_language_id": language_id.query,
        "op10_top_k": top_k.query,
        "op11_merkle_manifest": merkle.query,
        "op12_conversation_repair": conversations.query,
        "op13_url_filters": url_filters.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_top_k": top_k.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_conversation_repair": conversations.ORACLE, "op13_url_filters": url_filters.ORACLE}
