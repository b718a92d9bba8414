"""Discriminative pattern discovery over grouped sequences, on DataFrames."""
