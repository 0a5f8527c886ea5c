"""Structured Streaming forms of the append-only tables. Extensions: the batch operators define the semantics."""
