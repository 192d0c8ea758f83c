"""All queries of the package, with their SQL where there is one."""

from importlib import import_module

MODULES = ("q_unigram", "q_decontaminate", "q_licences", "q_quality", "q_shard", "q_similar", "q_mix", "q_toxicity", "q_html", "q_conversations", "q_simhash", "q_align")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = import_module(f"nomina.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
