"""Column functions: keys, text, dates, ratings."""
