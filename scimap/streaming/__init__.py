"""Streaming: none of the engine's operators is one.

Every input is a finite table or file. The operators are functions of DataFrames, so those that need no global order
(scans, filters, grouped counts) also take the batches that foreachBatch gives.
"""
