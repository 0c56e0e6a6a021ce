"""Readers and writers of genotype and sample files."""
