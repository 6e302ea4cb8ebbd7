"""Dataset-scale operators over documents, pages and vectors."""
