"""docsafe: a PySpark engine for document-text pipelines."""
