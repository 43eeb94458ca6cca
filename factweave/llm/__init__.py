"""Operators for training data (problems tagged llm); nothing outside this subpackage imports it."""
