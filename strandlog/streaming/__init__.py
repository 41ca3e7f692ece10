"""State kept from a stream of ops."""
