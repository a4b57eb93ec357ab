"""Jobs over arriving documents."""
