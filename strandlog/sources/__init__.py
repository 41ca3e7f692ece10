"""The interchange format and its DataFrame readers and writers."""
