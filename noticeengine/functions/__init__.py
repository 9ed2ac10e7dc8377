"""Column functions: text, codes, dates, brands and identifiers."""
