"""Reading archives: listing, planning, lines, integrity."""
