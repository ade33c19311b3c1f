"""Column-level building blocks: names, types, literals, dates, patterns."""
