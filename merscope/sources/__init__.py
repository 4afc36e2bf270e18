"""Readers: FASTA and FASTQ files, and sequence columns of other sources."""
