"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries()`` lists one query per
operator, ``oracle_sql()`` the DuckDB equivalents where SQL can express them.
"""
