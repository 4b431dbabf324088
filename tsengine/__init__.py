"""Forecasting and evaluation of large panels of time series on Spark DataFrames."""
