"""The catalogue's queries: each module has QUERIES, from a name to a function of (spark, sf_dir) and its SQL, or None where SQL cannot say it."""
