"""Report plans (R1-R4), the query registry and the SQL oracle."""
