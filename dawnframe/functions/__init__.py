"""Part of dawnframe; see README.md for the map of modules."""
