"""inkfold: document-ML data processing as Spark DataFrame jobs."""
