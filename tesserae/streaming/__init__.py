"""streaming of tesserae."""
