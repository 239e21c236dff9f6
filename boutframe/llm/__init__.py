"""Operators for preparing large text collections. Nothing else in this package imports them."""
