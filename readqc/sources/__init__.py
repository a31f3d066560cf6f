"""Where reads come from: FASTQ and FASTA files, and the driver tables."""
