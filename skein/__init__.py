"""skein: a PySpark-native analytics engine for node telemetry."""
