"""quern: constraint-answer evaluation and text-corpus work as PySpark jobs."""
