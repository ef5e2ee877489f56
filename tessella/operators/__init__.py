"""DataFrame to DataFrame operators over images, levels, tiles and requests."""
