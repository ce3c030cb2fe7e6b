"""Operators over DataFrames: splits, votes, metrics, calibration, chunks, planning and matching."""
