"""Signal processing in NumPy: pure functions on arrays, called on Arrow batches."""
