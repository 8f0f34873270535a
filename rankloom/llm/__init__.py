"""Operators for building training corpora over the tables documents, pages, benchmark, labels and conversations."""
