"""Relational operators over documents, chunks and hits."""
