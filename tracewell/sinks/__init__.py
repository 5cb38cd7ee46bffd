"""Writers: panels, snapshots with keyed upserts, quarantine, fan-out, change-only output."""
