"""The row-wise operators over arriving files."""
