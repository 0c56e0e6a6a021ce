"""Special functions as Columns and small numpy helpers."""
