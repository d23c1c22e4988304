"""Generic operators: ordered scans, as-of joins, interval algebra, sessions, top-k, sets."""
