"""Graph operators over edge tables."""
