"""sources of tesserae."""
