from tradebook.sources.files import checkpoint_dir, converted, read_table, read_tables, scratch_path, write_table
from tradebook.sources.store import Store

__all__ = ["Store", "checkpoint_dir", "converted", "read_table", "read_tables", "scratch_path", "write_table"]
