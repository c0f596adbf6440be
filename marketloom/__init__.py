"""marketloom: Spark-native analytics for daily market series and the dated text around them."""
