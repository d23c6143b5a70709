"""tidemark: a PySpark engine for dated, labelled text corpora."""
