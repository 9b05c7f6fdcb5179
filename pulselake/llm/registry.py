"""The corpus operators' queries and SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from pulselake.llm import oracles, queries

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op")}
ORACLES = {name: sql for name, sql in {
    "op1_rlz_substring_dedup": oracles.OP1,
    "op4_line_runs": oracles.OP4,
    "op6_warc": oracles.OP6,
    "op7_balltree_topk": oracles.OP7,
    "op8_decontaminate": oracles.OP8,
    "op9_mixture": oracles.OP9,
}.items()}
