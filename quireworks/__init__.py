"""Document-structure analytics expressed as DataFrame transformations."""
