"""Software-estate analytics as Spark DataFrame programs."""
