"""Operators of a training-data pipeline over text corpora.

Nothing outside this subpackage imports it; `strandloom.llm.queries` registers its queries.
"""
