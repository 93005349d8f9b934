"""Relations and end-to-end plans."""
