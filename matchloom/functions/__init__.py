"""Column functions: lists, tokens, skills, text cleaning and vacancy fields. All are built-in expressions."""
