"""Schemas of the tables that pass between operators. Every table is keyed by file_id, and by run_id where a response is meant."""

from __future__ import annotations

FUNCTIONS = "file_id string, ord long, name string, lineno int, args array<string>, returns string, calls array<string>, variables array<string>, docstring string"
CLASSES = "file_id string, ord long, name string, lineno int, bases array<string>, methods array<string>, attributes array<string>, docstring string"
VARIABLES = "file_id string, ord long, name string, lineno int, scope string, assigned_value string, dependencies array<string>"
IMPORTS = "file_id string, ord long, module string, names array<string>, alias string, lineno int"
CALL_REL = "file_id string, caller string, callee string"
NODES = "file_id string, graph string, id string, node_type string, lineno int"
EDGES = "file_id string, graph string, src string, dst string, relationship string, graph_source string"
RESPONSES = "file_id string, run_id string, content string, reasoning_steps array<string>, model string, usage map<string,int>"
CLAIMS = "file_id string, run_id string, ord long, text string, claim_type string, subject string, object string, predicate string, confidence double, source_step int, metadata map<string,string>"
CLAIM_TYPES = ("call", "data_flow", "existence", "attribute", "relationship", "unknown")
MATCH_TYPES = ("exact", "fuzzy", "alias", "partial", "no_match")
RESULTS = ("valid", "hallucination", "unverifiable", "partially_valid")
