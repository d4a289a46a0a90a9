"""Operators for preparing text and code for language models. Nothing outside this folder imports it."""
