"""Tapeloom: a PySpark-native analytics engine for corpora of short text and audio records."""
