"""Helmsway: sensor-stream analytics as Spark DataFrame operators."""
