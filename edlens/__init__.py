"""edlens: learning and behaviour analytics as composable Spark DataFrame operators."""
