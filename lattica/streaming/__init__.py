"""Graph statistics kept over a stream of edges."""
