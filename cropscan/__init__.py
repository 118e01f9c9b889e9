"""Crop-imagery analytics as PySpark DataFrame functions."""
