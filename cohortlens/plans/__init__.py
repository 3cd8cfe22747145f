"""Derived views of the star schema, and the catalogue of queries over them."""
