"""Operators that prepare training data for language models.

Nothing else in the library imports this subpackage. Each module holds one operator; ``queries``
applies them to the driver's tables.
"""
