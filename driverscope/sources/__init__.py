"""Readers and writers of the study's files."""
