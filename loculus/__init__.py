"""Spatial-entity analytics on Spark: detections in, entities, relations and answers out."""
