"""Part of sievestone."""
