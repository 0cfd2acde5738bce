"""As-of joins of streams against tables."""
