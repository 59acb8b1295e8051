"""Readers and writers: Matrix-Market text, vector distributions, any table as a matrix."""
