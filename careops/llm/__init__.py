"""Operators for preparing large text corpora.

One module per operator, ``queries`` registers them and ``oracles`` holds the
DuckDB SQL of those that SQL can express.  Nothing outside this subpackage
imports it.
"""
