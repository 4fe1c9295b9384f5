"""Operations of a large training-data pipeline: thirteen operators, their registered queries and their SQL.

Nothing else in the library imports this subpackage. Each operator module has a general interface with real outputs
(texts, spans, files); ``queries.py`` derives the registered ``opN_<name>`` results from them.
"""
