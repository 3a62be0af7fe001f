"""The queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from ordertide.llm import attention, automaton_dedup, bag_minhash, gamma_samples, language, lattice, mixing, ranked_search, repair, suffix_dedup, surrogates, url_rules, winnow
from ordertide.llm.text import table

QUERIES = {
    "op1_language": language.op1_language,
    "op2_bag_minhash": bag_minhash.op2_bag_minhash,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_attention": attention.op4_attention,
    "op5_surrogates": surrogates.op5_surrogates,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_automaton_dedup": automaton_dedup.op8_automaton_dedup,
    "op9_gamma_samples": gamma_samples.op9_gamma_samples,
    "op10_winnowing": lambda spark, sf_dir: winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_lattice_hashing": lattice.op13_lattice_hashing,
}
ORACLES = {"op6_mixing": mixing.ORACLE, "op12_ranked_search": ranked_search.ORACLE}
