"""Record linkage and analytics as lazy Spark DataFrame plans."""
