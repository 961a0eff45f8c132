"""Training-data operators (numbered 1 to 10). Nothing outside this folder imports it."""
