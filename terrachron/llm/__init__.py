"""Training-data operators: fingerprints, scans, scores, joins, mixing and sharding.

Nothing else in the package imports this subpackage; ``queries.py`` here holds
the queries and SQL that ``__spark_entry__`` adds when the folder is present.
"""
