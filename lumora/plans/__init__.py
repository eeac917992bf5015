"""Registered queries over the catalog projections, and their SQL."""
