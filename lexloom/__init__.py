"""lexloom: document retrieval and question-answering analytics as PySpark DataFrame operators."""
