"""Operators for preparing training text at corpus scale; their queries are in ``queries``."""
