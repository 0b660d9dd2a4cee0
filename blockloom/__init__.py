"""Change logs, change sets, block images and snapshot catalogues as Spark jobs."""
