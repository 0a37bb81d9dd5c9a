"""Operators for preparing large text and sequence corpora. Nothing else in the library imports this subpackage."""
