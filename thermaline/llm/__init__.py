"""Operators on the texts of a corpus. Nothing else in the library imports this subpackage."""
