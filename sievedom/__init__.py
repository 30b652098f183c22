"""sievedom: HTML, CSS and Markdown sanitising and DOM analytics on Spark DataFrames."""
