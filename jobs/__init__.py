"""Runnable jobs: python -m jobs.NAME --config jobs/NAME.json, with paths of any file system that Spark reads."""
