"""Training-data operators: ten self-contained components and their registered queries.

Nothing outside this package imports it, so it can be removed without touching the rest of the library.
"""
