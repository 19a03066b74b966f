"""Training-data operators: deduplication, filtering, mixing and token output.

Nothing outside this subpackage imports it.  ``llm.registry`` lists the
queries that ``__spark_entry__.py`` adds when the subpackage is present.
"""
