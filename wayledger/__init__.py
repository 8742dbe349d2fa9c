"""wayledger: place-and-time analytics on road works and street reports, as PySpark DataFrame operators."""
