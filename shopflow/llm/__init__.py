"""Operators and a pipeline for large training corpora (documents, pages, conversations)."""
