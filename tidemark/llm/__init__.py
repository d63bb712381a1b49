"""Operators for training-data pipelines over the tables documents, pages, embeddings, benchmark and labels."""
