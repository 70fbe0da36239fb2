"""gamelode: a PySpark-native product-analytics engine over event envelopes."""
