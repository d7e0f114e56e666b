"""See the package docstring in weftline."""
