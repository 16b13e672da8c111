"""Tables, run records and streams by path or topic."""
