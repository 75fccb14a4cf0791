"""Operators for preparing training data. Nothing else in veilspark imports this subpackage."""
