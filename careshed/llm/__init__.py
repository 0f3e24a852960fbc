"""Training-data operators: filters, deduplication, scans, packing. Nothing else in the library imports this."""
