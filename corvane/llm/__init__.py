"""Operators for preparing training data; nothing else in corvane imports this subpackage."""
