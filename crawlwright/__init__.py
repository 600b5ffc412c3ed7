"""Crawl audits as Spark jobs: pages, images, links, fetch logs and sitemaps of many sites at once."""

__version__ = "0.1.0"
