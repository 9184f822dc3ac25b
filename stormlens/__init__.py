"""stormlens: storm, sensor-fleet and wildfire analytics as PySpark DataFrame operators."""
