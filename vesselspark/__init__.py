"""Vessel-trace and segmentation-evaluation analytics as Spark DataFrame jobs."""
