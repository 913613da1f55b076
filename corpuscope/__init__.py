"""Corpuscope: semantic analytics over text corpora with embeddings, on PySpark."""
