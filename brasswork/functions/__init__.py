"""Part of brasswork."""
