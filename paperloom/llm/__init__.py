"""Operators for building language-model training corpora.

Each module holds one operator with a general interface; ``queries`` holds the
thin ``opN_*`` queries over the driver tables and ``oracles`` their SQL.
Nothing else in the library imports this subpackage.
"""
