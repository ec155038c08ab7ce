"""Loomgrid: an analytics engine expressed in Spark DataFrames."""
