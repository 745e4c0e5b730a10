"""Training-data operators: language ID, deduplication, mixing, tokenising, classifiers and search.

Nothing else in the library imports this subpackage; deleting it leaves the rest whole.
"""
