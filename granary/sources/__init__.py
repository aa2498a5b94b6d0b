"""Where tables come from and live: workspaces, layouts, CSV files."""
