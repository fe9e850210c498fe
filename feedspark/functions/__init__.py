"""Column expressions.  All are native Spark expressions unless the module
says otherwise (``udfs``)."""
