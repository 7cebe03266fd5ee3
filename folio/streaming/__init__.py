"""Structured Streaming operators."""

from folio.streaming.jobs import dedupe_url_stream, enrich_stream, latest_status, live_metrics, queue_waits, run_available, status_feed

__all__ = ["dedupe_url_stream", "enrich_stream", "latest_status", "live_metrics", "queue_waits", "run_available", "status_feed"]
