"""Tidemark: a Spark-native engine for signed verification records and text corpora.

Every operator takes DataFrames and returns DataFrames; Spark plans, shuffles and
runs the work.  ``tidemark.llm`` holds the training-data operators and is optional:
nothing outside it imports it.
"""
