"""netaccess: network accessibility analytics as lazy Spark DataFrame operators."""
