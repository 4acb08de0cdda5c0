from holdfast.sources.tables import (
    Tables, broken_records, open_bucketed, read_tables, register_views, unreadable, write_bucketed, write_table,
)

__all__ = ["Tables", "broken_records", "open_bucketed", "read_tables", "register_views", "unreadable", "write_bucketed", "write_table"]
