"""Dataset cleaning, profiling and evaluation for tables, graphs and images on Spark."""
