"""Finance-document checking and reconciliation as Spark jobs."""
