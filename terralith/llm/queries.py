"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from terralith.llm import bpe, jaccard, language, licenses, mixing, personal, quality, repair, repeats, secrets, setsketch, topk, trie


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_topk": topk.op3_topk,
        "op4_bpe": bpe.op4_bpe,
        "op5_licenses": licenses.op5_licenses,
        "op6_language": language.op6_language,
        "op7_repeats": repeats.op7_repeats,
        "op8_personal": personal.op8_personal,
        "op9_mixing": mixing.op9_mixing,
        "op10_jaccard": jaccard.op10_jaccard,
        "op11_repair": repair.op11_repair,
        "op12_setsketch": setsketch.op12_setsketch,
        "op13_trie": trie.op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": secrets.oracle_sql(),
        "op3_topk": topk.ORACLE_SQL,
        "op9_mixing": mixing.ORACLE_SQL,
        "op10_jaccard": setsketch.link_sql(jaccard.PERCENT),
        "op11_repair": repair.oracle_sql(),
        "op12_setsketch": setsketch.ORACLE_SQL,
        "op13_trie": trie.oracle_sql(),
    }
