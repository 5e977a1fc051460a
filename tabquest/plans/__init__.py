"""Jobs composed from sources, functions and operators."""
