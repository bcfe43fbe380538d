"""Readers and writers of count tables, sequence files, designs and stored matrices."""

from .bgzf import read_lines as read_block_gzip_lines
from .binary import read_binary_index, read_binary_selection
from .designs import continuous_design, label_design, normalisation_factors, up_down_design
from .sequences import in_input_order, read_fasta, read_fastq, write_fasta
from .tables import read_counts, read_index, write_buckets, write_counts, write_index

__all__ = ["continuous_design", "in_input_order", "label_design", "normalisation_factors", "read_binary_index", "read_binary_selection", "read_block_gzip_lines", "read_counts", "read_fasta", "read_fastq", "read_index", "up_down_design", "write_buckets", "write_counts", "write_fasta", "write_index"]
