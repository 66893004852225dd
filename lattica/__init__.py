"""Lattica: structure-aligned evidence retrieval expressed as Spark DataFrame stages."""
