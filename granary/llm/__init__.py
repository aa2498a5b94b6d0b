"""Training-data operators on DataFrames of documents, pages and conversations.

Nothing outside this subpackage imports it.
"""
