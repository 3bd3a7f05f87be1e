"""Configuration of a reconciliation run: templates, mappings, code lists."""
