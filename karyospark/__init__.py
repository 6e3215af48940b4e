"""Batch jobs for comparing gene order between genomes, as DataFrame-in, DataFrame-out functions."""
