"""quillspark: corpus and learning analytics as PySpark DataFrame functions."""
