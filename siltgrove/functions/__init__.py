"""Part of siltgrove."""
