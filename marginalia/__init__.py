"""Documents, web pages and conversation memory as Spark tables."""
