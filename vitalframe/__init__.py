"""vitalframe: a PySpark-native analytics engine for multimodal biosignal studies."""
