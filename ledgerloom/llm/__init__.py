"""Operators for preparing entity and text data; nothing else in the library imports this subpackage."""
