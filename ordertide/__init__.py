"""Process-aware order analytics as composable Spark DataFrame operators."""
