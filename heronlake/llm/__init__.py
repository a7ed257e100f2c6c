"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; :mod:`heronlake.llm.registry` derives the
``opN_*`` queries from them.
"""
