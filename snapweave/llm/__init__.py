"""Training-data operators: near-dedup, packing, quality, extraction, search, licences, segmentation."""
