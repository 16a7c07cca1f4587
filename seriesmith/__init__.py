"""Error-bounded compression of numeric time series, and a time index, on Spark."""
