"""Relational operators over archive catalogs and tables of records."""
