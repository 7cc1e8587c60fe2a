"""Column expressions; nothing in here runs Python per row."""
