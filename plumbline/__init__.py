"""Document-fidelity analytics on Spark."""
