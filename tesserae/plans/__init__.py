"""plans of tesserae."""
