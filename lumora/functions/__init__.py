"""Part of the catalog library."""
