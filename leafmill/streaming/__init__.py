"""Structured Streaming forms of keyed state. The batch forms are in ``operators.state``."""
