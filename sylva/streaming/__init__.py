"""Handing out parts one after the other."""
