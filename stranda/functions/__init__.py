"""Column functions: coordinates, CIGARs, bases, qualities, flags, variants, text."""
