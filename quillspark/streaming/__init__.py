"""The lint transform over streams of documents."""
