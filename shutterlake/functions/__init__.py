"""Column functions: text, places, dates and vectors."""
