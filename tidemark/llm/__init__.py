"""Operators of a training-data pipeline over tables of documents, pages and conversations.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered
queries and their SQL; every other module holds one operator.
"""
