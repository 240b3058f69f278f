"""polyad: a signed-network and corpus analytics engine on Spark."""
