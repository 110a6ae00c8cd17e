"""Catalogs that grow: appended archives as a file stream, and rules on when to append."""
