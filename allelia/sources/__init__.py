"""Readers for genotype, phenotype, relationship and group files."""
