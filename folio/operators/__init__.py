"""DataFrame operators grouped by relation: documents, timeline, stats,
jobs, crawl, merges, images and publish."""

from folio.operators import crawl, documents, images, jobs, merges, publish, stats, timeline

__all__ = ["crawl", "documents", "images", "jobs", "merges", "publish", "stats", "timeline"]
