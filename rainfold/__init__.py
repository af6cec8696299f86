"""rainfold: terrain, runoff and water-storage analytics as Spark DataFrame operators."""
