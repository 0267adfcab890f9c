"""Training-data operators: mixing, encoding, fingerprints, dedup, classification, chat."""
