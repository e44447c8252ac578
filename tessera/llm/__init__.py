"""Operators for preparing training data: one module each, with their queries in tessera.llm.queries."""
