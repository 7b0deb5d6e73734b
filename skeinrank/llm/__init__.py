"""Training-data operators: each module holds one operator over DataFrames of documents, pages or vectors."""
