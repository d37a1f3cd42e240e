"""DataFrame operators over documents, chunks, questions and vectors."""
