"""Operators for large training-data pipelines.

Ten operators live here, one module each; :mod:`kpimill.llm.queries` registers one query for each of them.  Nothing
else in the library imports this subpackage.
"""
