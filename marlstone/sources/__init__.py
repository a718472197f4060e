"""Where listings and bars come from."""
