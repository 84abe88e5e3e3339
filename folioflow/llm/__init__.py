"""Training-data operators for very large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`folioflow.llm.queries` binds them to the
driver's tables.
"""
