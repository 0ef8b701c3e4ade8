"""Operators that prepare a corpus of documents for training, and their registered queries."""
