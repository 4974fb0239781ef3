"""Operators for preparing training text: tokens, near copies, archives, packing, search and scoring."""
