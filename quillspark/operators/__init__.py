"""Operators over documents, units, labels and studies: functions from DataFrames to DataFrames."""
