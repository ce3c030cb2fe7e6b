"""Readers: Parquet tables, tab-separated tables with their checks, FASTA and BAM as Spark data sources."""
