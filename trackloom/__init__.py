"""Trajectory analytics on Spark: detections in, clean identity tracks and scores out."""
