"""Column functions: normalisation, masking, hashing, checksums, marker counting."""
