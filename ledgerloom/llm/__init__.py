"""Operators for preparing language-model training data.

One module per operator, each with a DataFrame-in, DataFrame-out interface;
``queries`` holds the thin registered queries and ``oracles`` their SQL.
Nothing outside this subpackage imports it.
"""
