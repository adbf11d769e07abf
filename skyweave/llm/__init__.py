"""Operators of a training-data pipeline over text corpora.  Nothing else in skyweave imports this subpackage."""
