"""Operators for preparing language-model training data.

Every module here holds one operator with a general interface; ``queries``
registers one thin query for each and ``oracle`` the SQL that DuckDB can check.
Nothing outside this subpackage imports it.
"""
