"""Training-data operators: encoding, filtering, near duplicates and mixing."""
