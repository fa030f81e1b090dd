"""No streaming operators: indexes are built once and never change."""
