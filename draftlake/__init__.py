"""PySpark-native analytics over engineering drawings (and, in ``draftlake.llm``, training-data operators)."""
