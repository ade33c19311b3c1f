"""Looking at data: tests, freshness, profiles, and what a join does to rows."""
