"""Operators that prepare corpora for language models. Nothing else in the library imports this subpackage."""
