"""Document analytics on Spark: layout, segmentation, matching, scoring and admission control."""
