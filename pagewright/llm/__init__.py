"""Operations for building training corpora.

Nothing outside this subpackage imports it. Every operator module has a
general interface that takes and returns DataFrames; ``registry`` turns them
into the registered queries.
"""
