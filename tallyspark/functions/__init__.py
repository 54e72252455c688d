"""Column expressions: text, dates, amounts, periods."""
