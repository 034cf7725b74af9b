"""Document retrieval and grounded question answering as PySpark DataFrame plans."""
