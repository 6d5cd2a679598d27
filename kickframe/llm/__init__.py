"""Operators for preparing training text at scale; nothing else in kickframe imports this package."""
