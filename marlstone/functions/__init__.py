"""Expression text shared by engines."""
