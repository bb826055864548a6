"""Column functions over bytes and pixels."""
