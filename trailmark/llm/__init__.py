"""Training-data operators: joins, archives, media, dedup, search, packing,
extraction, classifiers and mixing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
