"""Near-duplicate analysis as composable DataFrame operators."""
