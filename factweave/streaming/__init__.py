"""Structured Streaming forms of a few operators (an extension; the batch forms are the contract)."""
