"""operators of tesserae."""
