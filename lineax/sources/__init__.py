"""Sources and sinks (#1–5): FASTA, TSV and CSV as splittable Spark scans."""

from lineax.sources.fasta import read_fasta
from lineax.sources.text import read_csv, read_tsv, snake_case_columns, write_csv, write_tsv

__all__ = ["read_fasta", "read_csv", "read_tsv", "snake_case_columns", "write_csv", "write_tsv"]
