"""Training-data operators for very large corpora.

Each module holds one operator with a general interface; ``queries`` binds
them to the standard tables.  Nothing outside this subpackage imports it.
"""
