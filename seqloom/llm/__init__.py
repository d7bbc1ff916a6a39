"""Operators for preparing training text. Nothing else in seqloom imports this subpackage."""
