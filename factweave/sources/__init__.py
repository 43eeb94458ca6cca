"""Scans and writers: JSON documents, traces, program text, registries, reports."""
