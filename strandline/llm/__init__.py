"""Training-data operators: thirteen numbered operators over text, page and media columns.

Nothing else in the library imports this subpackage.
"""
