"""Sources: what is known about them, how they are read, staged and described."""
