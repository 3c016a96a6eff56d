"""hostledger: web-inventory analytics as plain Spark DataFrame jobs."""
