"""Event, interval and audio-feature analytics on Spark DataFrames."""
