"""Operations for building training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`chronotag.llm.registry` turns the operators
into the ``opN_<name>`` queries.
"""
