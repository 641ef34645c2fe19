"""Queries and SQL that this subpackage adds."""

from quillon.llm import oracles, queries

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op") and name[2].isdigit()}
ORACLES = {"op1_chat_formatting": oracles.OP1, "op4_minhash_near_dedup": oracles.OP4, "op5_embedding_near_dedup": oracles.OP5, "op11_substring_dedup": oracles.OP11, "op12_merkle_manifest": oracles.OP12}
