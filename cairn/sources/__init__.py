"""Readers: archives of many formats, catalogs, folders; each gives catalog rows."""
