"""Physical strategies of the as-of join; all give the same result."""
