"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it; ``quillmill.llm.queries`` lists
the registered queries and their SQL.
"""
