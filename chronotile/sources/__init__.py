"""Readers and writers: catalogs, sample files, results."""
