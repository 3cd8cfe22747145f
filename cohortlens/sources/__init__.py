"""Reading and writing: label tables, file listings, reports."""
