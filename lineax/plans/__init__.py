"""End-to-end jobs (#90–102) and the stand-in tables built from the driver's data."""
