"""Windows event-log triage and detection as Spark DataFrame and Column operators."""
