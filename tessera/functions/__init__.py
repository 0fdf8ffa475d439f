"""Column functions: text, numbers, arrays. All native expressions but the two similarity ratios in fuzzy.py."""
