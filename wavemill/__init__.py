"""Wavemill: PySpark-native analytics over radio-channel captures and event tables."""
