"""Publishing results: single files, spools, partitioned archives, tables."""
