"""A PySpark library for item catalogues: cleaning, features, explainable scores, search, history and reports."""
