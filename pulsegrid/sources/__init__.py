"""Tables, signal blobs, laboratory files, synthetic data and sinks."""
