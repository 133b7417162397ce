"""webcorpus: turn a corpus of fetched web pages into records with PySpark."""
