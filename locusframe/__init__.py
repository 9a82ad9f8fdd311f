"""Genotype, phenotype and relationship analytics as Spark DataFrame programs."""
