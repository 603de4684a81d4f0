"""Readers of chapter folders, index files, configuration and landed web pages."""
