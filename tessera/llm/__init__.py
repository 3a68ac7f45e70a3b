"""Training-data operators over the tables documents, conversations and pages.

Nothing else in the library imports this subpackage; it can be removed.
"""
