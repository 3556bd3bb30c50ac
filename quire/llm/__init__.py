"""Training-data operators. Nothing outside this folder imports it; see the README for the list."""
