"""Evidence-first corpus search and training-data preparation on PySpark."""
