"""A PySpark library for building and scoring benchmarks from procedure documents."""
