"""Point transforms as column expressions, and arrays resampled through them."""
