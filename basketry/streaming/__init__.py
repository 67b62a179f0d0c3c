"""Incremental ingest of order exports.

The analytics are batch jobs over whole tables; the source has no streaming
operators. What does arrive over time is the export files themselves, so this
package offers the typed order ingest as a Structured Streaming file source:
new CSV files in a folder are read with the same header-by-name selection and
day-first parsing as the batch reader.
"""

from .orders import order_export_stream

__all__ = ["order_export_stream"]
