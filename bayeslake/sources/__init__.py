"""Table reads, CSV, integer coding, standardisation and splits."""
