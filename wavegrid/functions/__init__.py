"""Part of wavegrid."""
