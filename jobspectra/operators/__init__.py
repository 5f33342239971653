"""DataFrame-level operators: metrics, upserts, segmentation, resume matching."""
