"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin, contract-shaped queries; the other modules hold the operators with their
own interfaces.
"""
