"""Registered queries and their SQL."""

from . import alignment_queries, eval_queries, graph_queries, sentence_queries, text_queries

MODULES = [eval_queries, graph_queries, text_queries, sentence_queries, alignment_queries]
QUERIES = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.SQL.items()}
