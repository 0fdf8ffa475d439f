"""A PySpark engine for preparing, profiling, searching and modelling study records."""
