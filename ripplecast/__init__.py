"""Social-cascade analytics as DataFrame -> DataFrame functions on Spark."""
