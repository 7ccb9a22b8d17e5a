"""A PySpark-native engine for geographic panels, graphs, units and the data
work around them. Everything takes and returns DataFrames keyed by location."""

__version__ = "0.1.0"
