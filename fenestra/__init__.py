"""Window fingerprints over event streams, as DataFrame plans."""
