"""Event-time windows over streams: an extension."""
