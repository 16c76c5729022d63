"""Training-data operators: one module per operator, each a DataFrame -> DataFrame function.

Nothing outside this subpackage imports it; ``gustline.llm.queries`` holds the
registered queries and their SQL.
"""
