"""Training-data operators: text, vectors, archives and token files at corpus scale."""
