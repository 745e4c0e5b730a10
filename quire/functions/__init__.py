"""Column expressions over text, URLs and HTML."""
