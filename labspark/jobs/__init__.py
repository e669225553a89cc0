"""Jobs to hand to spark-submit."""
