"""Training-data operators: ten large-corpus operations and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it can be imported.
"""
