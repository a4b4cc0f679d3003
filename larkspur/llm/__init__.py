"""Operators that prepare and inspect large training collections; nothing else in the library imports this package."""
