"""Column functions: text, dates, numbers, arrays and ordered rules. All are native expressions unless they say otherwise."""
