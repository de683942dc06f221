"""Code-search analytics, dataset building and record hygiene as PySpark jobs."""
