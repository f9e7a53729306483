"""Sources: landed listings, mail, notice feeds and stored pages -> raw items.

Raw item columns (``RAW_COLS``): seq (arrival order inside the batch),
source_type, source_name, external_id, raw_body, metadata (JSON text),
received_at.
"""

RAW_COLS = ["seq", "source_type", "source_name", "external_id", "raw_body", "metadata",
            "received_at"]
