"""Building blocks that more than one operator's plan uses."""
