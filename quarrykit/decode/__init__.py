"""Machine code to instruction rows."""
