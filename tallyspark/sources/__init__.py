"""Readers that Spark lacks, and the layouts of those it has."""
