"""Part of the glimmer analytics library."""
