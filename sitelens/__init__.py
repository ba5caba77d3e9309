"""Spark-native crawl and page analytics: stored pages in, typed tables out."""
