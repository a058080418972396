"""docloom: document detection, conversion, splitting and packaging as Spark DataFrame operations."""
