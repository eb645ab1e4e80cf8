"""Operators over DataFrames: ranking, fusion, the log fold, clustering, quantization, attribute indexes."""
