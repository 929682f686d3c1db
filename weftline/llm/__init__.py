"""Training-data operators: ten Spark jobs that clean, de-duplicate, mix and shard a text corpus.

Nothing else in the library imports this subpackage.
"""
