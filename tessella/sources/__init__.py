"""File sources and sinks for image files and tile tables."""
