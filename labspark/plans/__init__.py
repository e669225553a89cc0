"""Shuffle-shape helpers: splitting hot groups and picking top rows."""
