"""Where datasets come from and where results are written."""
