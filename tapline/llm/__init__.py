"""Training-data operators over documents, pages, embeddings and labels.

Nothing outside this subpackage imports it.
"""
