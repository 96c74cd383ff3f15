"""Racing and betting-market analytics as composable Spark DataFrame operators."""
