"""Order-fraud feature, label, quality and scoring jobs as Spark DataFrame programs."""
