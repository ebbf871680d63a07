"""Page-layout and text analytics on Spark."""
