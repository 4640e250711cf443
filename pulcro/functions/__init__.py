"""Column expressions: text, e-mail, phone, country and date functions."""
