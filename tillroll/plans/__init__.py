"""SQL report catalogue and the registered queries with their SQL counterparts."""
