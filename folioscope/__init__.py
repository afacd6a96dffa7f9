"""folioscope: document analytics on Spark."""
