"""Data-processing operators for energy-market series and warehouse upkeep.

Every operator takes DataFrames and plain parameters and returns a DataFrame.
"""
