"""Document-structure analytics as composable PySpark DataFrame operators."""
