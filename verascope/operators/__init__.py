"""Part of verascope."""
