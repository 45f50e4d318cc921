"""Document intelligence over whole tables, on the Spark DataFrame API."""
