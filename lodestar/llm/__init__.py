"""Corpus operators for training-data pipelines.

Nothing outside this folder imports it; it leans on PySpark, numpy and pyarrow, and packing on tokenizers and
a vocabulary file.
"""
