"""DataFrame operators: detectors and the joins and aggregates they share."""
