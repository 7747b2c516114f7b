"""Operators that prepare language-model training data.

Nothing outside this package imports it; ``registry`` lists its queries and
their DuckDB SQL.
"""
