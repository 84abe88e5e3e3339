"""Stand-ins for image-language drivers: scripted steps, recordings, a tiny image."""
