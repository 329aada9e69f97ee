"""functions of tesserae."""
