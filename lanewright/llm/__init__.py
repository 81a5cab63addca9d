"""Operators for preparing training corpora.

Each module holds one operator with its own general interface and, at the
end, the query function ``(spark, sf_dir) -> DataFrame`` that applies it to
the whole of its table with production parameters.  Nothing outside this
subpackage imports it.
"""
